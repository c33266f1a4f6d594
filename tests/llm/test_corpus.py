"""Near-duplicates, personal items, token ids and mixing against brute force and exact checks."""

import random

import numpy as np
import pytest

from quillspark.llm import neardup, pii
from quillspark.llm.mixing import mix, sainte_lague
from quillspark.llm.tokenizer import Encoder, MinimalPerfectHash, encode_table, encoder


def brute(sets, num=3, den=5):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}


def made_texts(n, seed):
    rng, words = random.Random(seed), [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(4, 60))] for _ in range(n // 3)]
    out = {}
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out[i] = " ".join(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = made_texts(150, seed) | {900: None, 901: "", 902: "two words", 903: "!!! ..."}
    names = {1000: "Report_ABC-2020 (1).pdf", 1001: "report abc 2020(1).txt", 1002: "other.pdf", 1003: None, 1004: "ab.pdf", 5: "report abc 2020.pdf"}
    t = spark.createDataFrame(list(texts.items()), "file_id bigint, text string")
    t = t.filter("text is not null and text <> ''")
    m = spark.createDataFrame(list(names.items()), "file_id bigint, file_name string")
    got = [tuple(r) for r in neardup.near_duplicates(t.unionByName(t), m).collect()]
    sets = {}
    for i, s in texts.items():
        w = neardup.WORDS.findall((s or "").lower())
        sets[i] = set(zip(w, w[1:], w[2:]))
    want = brute(sets)
    plain = {i: neardup.LETTERS.sub("", (n or "").lower().rpartition(".")[0]) for i, n in names.items() if i not in texts}
    want |= brute({i: {s[k : k + 3] for k in range(len(s) - 2)} for i, s in plain.items()})
    assert len(got) == len(set(got)) and set(got) == want and (1000, 1001) in want


def test_places_are_searched_by_ranges():
    rng, maps = np.random.default_rng(4), {}
    sets = {i: np.unique(rng.integers(0, 1 << 48, 40, dtype=np.uint64) if i % 3 else np.arange(i, i + 40, dtype=np.uint64) << np.uint64(41)) for i in range(90)}
    maps = [neardup.signature(h) for h in sets.values()]
    tokens = np.concatenate(list(sets.values()))
    docs = np.repeat(np.arange(90, dtype=np.uint32), [len(h) for h in sets.values()])
    positions = np.concatenate([np.arange(len(h), dtype=np.uint32) for h in sets.values()])
    order = np.argsort(tokens, kind="stable")

    def row():
        step = np.diff(tokens[order], prepend=np.uint64(0))
        split = lambda a, w: a.view(np.uint8).reshape(len(a), -1)[:, :w].T.tobytes()
        return {"ids": np.arange(90, dtype=np.int64).tobytes(), "sizes": np.array([len(h) for h in sets.values()], np.uint32).tobytes(), "maps": np.stack(maps).tobytes(), "tokens": split(step, 6), "docs": split(docs[order], 4), "positions": split(positions[order], 4)}

    whole = neardup.Place([row(), row()], 3, 5).pairs()
    entries = neardup.RANGE_ENTRIES
    try:
        neardup.RANGE_ENTRIES = 100
        parts = neardup.Place([row()], 3, 5).pairs()
    finally:
        neardup.RANGE_ENTRIES = entries
    assert len(whole) and {tuple(x) for x in whole} == {tuple(x) for x in parts}


def test_large_groups_go_through_the_tree(spark):
    rng = random.Random(5)
    texts = [(i, "alpha beta gamma delta " + " ".join(f"u{rng.randrange(9)}" for _ in range(6))) for i in range(260)]
    sets = {}
    for i, s in texts:
        w = s.split()
        sets[i] = set(zip(w, w[1:], w[2:]))
    t = spark.createDataFrame(texts, "file_id bigint, text string")
    none = spark.createDataFrame([], "file_id bigint, file_name string")
    assert {tuple(r) for r in neardup.near_duplicates(t, none).collect()} == brute(sets)
    assert neardup.near_duplicates(t.limit(0), none).count() == 0


def test_ten_thousand_copies_give_class_rows_and_split_pairs(spark):
    copies = spark.range(10_000).selectExpr("id AS file_id", "'one two three four five six seven eight nine ten' AS text")
    other = spark.createDataFrame([(20_000, "one two three four five six seven eight nine eleven"), (20_001, "nothing like it at all here")], "file_id bigint, text string")
    none = spark.createDataFrame([], "file_id bigint, file_name string")
    links = {(r.links, r.n) for r in neardup.near_duplicate_links(copies.unionByName(other), none).groupBy("links").count().withColumnRenamed("count", "n").collect()}
    assert links == {(10_000, 10_001), (0, 1)}
    members = spark.range(300).selectExpr("1L AS class", "id AS file_id").unionByName(spark.range(2).selectExpr("2L AS class", "id + 900 AS file_id"))
    got = neardup.pairs_within(members, block=40)
    assert got.count() == got.distinct().count() == 300 * 299 // 2 + 1 and got.selectExpr("least(f, g) AS f", "greatest(f, g) AS g").distinct().count() == 300 * 299 // 2 + 1


GIVEN, SURNAME = frozenset({"Clara", "Hugo", "Corvin"}), frozenset({"Varnicz", "Kestholt", "Oskar"})
TEXT = "Dear Mrs Clara Varnicz, call +44 1632 960092 or (393) 555-0159 ext. 12. Mail: c_varnicz (at) post [dot] test, 12b Weir Lane, Lindsund 00025. By Kestholt, Hugo and H. T. Kestholt for Velkegard Stores. SSN 000 45 0095; Part number 412-55-9071. Passport X00651608."


def test_equal_sets_are_searched_once(spark, monkeypatch):
    texts = made_texts(60, 3)
    rows = [(i * 100 + k, t) for k in range(20) for i, t in texts.items()]
    t = spark.createDataFrame(rows, "file_id bigint, text string").repartition(6)
    searched, search = [], neardup.candidate_pairs
    monkeypatch.setattr(neardup, "candidate_pairs", lambda sets, *rest: searched.append([r["class"] for r in sets.select("class").collect()]) or search(sets, *rest))
    sets = neardup.materialise(neardup.shingle_sets(t, "text", neardup.TextShingles(3)), "some-sets")
    got = {tuple(r) for r in neardup.similar_pairs(sets).collect()}
    classes = {r["class"] for r in sets.collect()}
    assert sorted(searched[0]) == sorted(classes)
    words = {i: x.split() for i, x in rows}
    assert got == brute({i: set(zip(w, w[1:], w[2:])) for i, w in words.items()})


def test_entities():
    found = [(k, TEXT[a:b]) for a, b, k in pii.entities(TEXT, GIVEN, SURNAME)]
    assert found == [
        ("person", "Clara Varnicz"), ("phone", "+44 1632 960092"), ("phone", "(393) 555-0159"), ("email", "c_varnicz (at) post [dot] test"),
        ("address", "12b Weir Lane, Lindsund 00025"), ("person", "Kestholt, Hugo"), ("person", "H. T. Kestholt"), ("id_number", "000 45 0095"), ("id_number", "X00651608"),
    ]


def test_surrogates():
    text = "Clara Varnicz wrote. Varnicz, Clara agreed; Hugo Kestholt did not."
    holders, made, _ = pii.replace(text, GIVEN, SURNAME, b"key")
    assert holders == "[PERSON_1] wrote. [PERSON_1] agreed; [PERSON_2] did not."
    first, last = made.split()[:2]
    assert f"{last}, {first} agreed" in made and "Varnicz" not in made and "Clara" not in made
    assert pii.replace(text, GIVEN, SURNAME, b"key")[1] == made != pii.replace(text, GIVEN, SURNAME, b"other")[1]
    phone = pii.surrogate("phone", "+49 30 23125 623", b"k")
    assert phone.startswith("+49 ") and [len(x) for x in phone.split()] == [3, 2, 5, 3]


def test_replacing_ends_for_any_entity():
    for text in ("p@o.at", "box@box.at", "a@b.test", "PO@DOT.AT", "P. O. Box 1, Oslo", "0 0 0", "+0 0 0", "x (at) y [dot] z", "A00000000"):
        holders, made, found = pii.replace(text, GIVEN, SURNAME, b"key")
        for kind, item in found:
            assert pii.identity(kind, pii.surrogate(kind, item, b"key")) != pii.identity(kind, item)
        assert len(made) == len(text)


def test_surrogates_are_distinct_over_the_corpus():
    import itertools

    names = ["".join(x) for x in itertools.product("abdeklmo", repeat=3)] + ["anna", "hanna", "maria", "иван", "ольга", "łucja", "a" * 60, "a" * 61]
    made = {pii.surrogate("person", f"{n.capitalize()} Varnicz", b"k").split()[0].lower() for n in names}
    assert len(made) == len(names)
    assert all((pii.name_word(n, b"k")[-1] in pii.FEMININE) == (n[-1] in pii.FEMININE) and pii.name_word(n, b"k") != n for n in names if len(n) > 2)
    assert pii.surrogate("person", "Hugo Varnicz", b"k")[0] == pii.surrogate("person", "H. Varnicz", b"k")[0]
    phones = [f"{i:07d}" for i in range(3000)]
    assert len({pii.surrogate("phone", f"0393 {p}", b"k") for p in phones}) == len(phones)
    assert len({pii.permuted(f"{i:03d}", b"k", "x") for i in range(1000)}) == 1000


def test_names_in_other_scripts():
    found = pii.entities("Иван Петров, +44 1632 960092", frozenset({"Иван"}), frozenset({"Петров"}))
    assert [k for _, _, k in found] == ["person", "phone"]
    assert pii.surrogate("person", "Иван Петров", b"k").isascii() is False


def test_redacting_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "plain text"), (4, "mail a@b.test")], "file_id bigint, text string")
    out = {r.file_id: r.redacted for r in pii.redact(d, names=(GIVEN, SURNAME)).collect()}
    assert out == {1: None, 2: "", 3: "plain text", 4: "mail [EMAIL_1]"}
    assert pii.find_entities(d.limit(0), (GIVEN, SURNAME)).count() == 0


def test_names_seen_once_and_unambiguous_mentions(spark):
    rows = [(1, "Dear Mr Tavo Brenwick, we thank you."), (2, "Signed by Tavo Brenwick on Monday."), (3, "Ms Elin Q. Sorvath and Mrs U. Dalk, residing here."), (4, "Then Elin Sorvath left Sorvath Stores.")]
    d = spark.createDataFrame(rows, "file_id bigint, text string")
    want = {(1, "Tavo Brenwick"), (2, "Tavo Brenwick"), (3, "Elin Q. Sorvath"), (3, "U. Dalk"), (4, "Elin Sorvath")}
    assert {(r.file_id, r.found_text) for r in pii.find_entities(d.unionByName(d)).collect()} == want
    assert pii.persons("Mr Tavo Brenwick and Tavo Brenwick", frozenset(), frozenset()) == [(3, 16)]
    redacted = {r.file_id: r.redacted for r in pii.redact(d).collect()}
    assert redacted[2] == "Signed by [PERSON_1] on Monday."


def test_names_beyond_the_broadcast_are_joined(spark, monkeypatch):
    rows = [(1, "Mr Tavo Brenwick, Ms Elin Sorvath, Dr Elin Sorvath"), (2, "By Tavo Brenwick."), (3, "By Brenwick, Tavo."), (4, None), (5, "By ELIN SORVATH.")]
    d = spark.createDataFrame(rows, "file_id bigint, text string")
    want = {(r.file_id, r.found_text) for r in pii.find_entities(d).collect()}
    assert {(2, "Tavo Brenwick"), (3, "Brenwick, Tavo"), (5, "ELIN SORVATH")} <= want
    whole = {tuple(r) for r in pii.redact(d).collect()}
    for most in (1, 3):
        monkeypatch.setattr(pii.with_names, "__defaults__", (most,))
        assert {(r.file_id, r.found_text) for r in pii.find_entities(d).collect()} == want
        assert {tuple(r) for r in pii.redact(d).collect()} == whole


def test_perfect_hash():
    keys = {f"key{i}".encode(): i for i in range(2000)}
    t = MinimalPerfectHash(keys)
    assert sorted(t.ids) == list(range(2000)) and all(t.get(k) == v for k, v in keys.items()) and t.get(b"other") == -1


def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", " ", "﻿", "<|endoftext|>", "don't I'll\r\n\t x", "日本語 ñandú 😀" * 3, "a" * 5000, "é​"] + ["".join(chr(rng.choice([32, 48, 97, 122, 233, 0x4E2D, 10, 33])) for _ in range(80)) for _ in range(60)]
    enc = encoder()
    for s in texts:
        assert enc.encode(s) == t.encode(s, add_special_tokens=False).ids
    assert all(enc.merge(k) == (i,) for k, i in zip(enc.table.keys[:3000], enc.table.ids[:3000]))
    d = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world")], "doc_id bigint, text string")
    out = [(r.doc_id, r.ids) for r in encode_table(d).orderBy("doc_id").collect()]
    assert out[:2] == [(1, []), (2, [])] and len(out) == 4 and out[2] == out[3]


def test_encoder_travels():
    import pickle

    e = pickle.loads(pickle.dumps(encoder()))
    assert isinstance(e, Encoder) and e.encode("some text") == encoder().encode("some text")


def test_apportionment():
    assert sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    assert sainte_lague({"a": 1, "b": 1}, 3) == {"a": 2, "b": 1}  # a tie goes to the smaller key
    assert sainte_lague({"a": 1, "b": 1}, 10, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert sainte_lague({}, 5) == {} and sainte_lague({"a": 0}, 5) == {"a": 0}
    w = {i: float(np.random.default_rng(i).integers(1, 900)) for i in range(40)}
    seats = sainte_lague(w, 10_000)
    assert sum(seats.values()) == 10_000 and all(abs(seats[i] - 10_000 * w[i] / sum(w.values())) < 1.5 for i in w)


def test_mix(spark):
    rows = [(i, "some words of text here " * (1 + i % 5), " Big " if i % 2 else "BIG") for i in range(300)] + [(1000 + i, "tiny note text " * 3, "small") for i in range(20)] + [(2000, None, "big"), (2001, "x y", None), (2002, "x", "unknown")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.25, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats bigint")
    chosen, report = mix(d.unionByName(d), targets)
    c = chosen.toPandas()
    assert c.doc_id.is_unique and set(c.source) == {"big", "small"} and c[c.source == "small"].copies.max() <= 3 and c[c.source == "big"].copies.max() == 1
    r = {x.source: x for x in report.collect()}
    assert abs(r["small"].actual_share - 0.25 / 0.95) < 0.03 and r["absent"].actual_share == 0.0
    empty, nothing = mix(d.limit(0), targets)
    assert empty.count() == 0 and nothing.count() == 3


def test_quota_that_a_shard_cannot_hold_goes_to_the_others(spark):
    from quillspark.llm.mixing import spread_quota

    out = spread_quota({0: 100, 1: 10, 2: 1}, 200.0, 30.0, 2)
    assert abs(sum(out.values()) - 200) < 1e-6 and all(out[k] <= 2 * n + 1e-9 for k, n in {0: 100, 1: 10, 2: 1}.items())
    rows = [(i, "some words of text here " * (1 + i % 7), "a" if i % 3 else "b") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 3)], "source string, target_share double, max_repeats bigint")
    reports = [{r.source: r for r in mix(d, targets, shard_tokens=s, max_groups=g)[1].collect()} for s, g in ((2_000_000, 4096), (300, 4096), (300, 3))]
    for r in reports:
        assert abs(r["a"].actual_share - 0.6) < 0.03 and r["a"].highest_repeat <= 2 and r["b"].highest_repeat <= 3
        assert abs(sum(x.mixed_tokens for x in r.values()) / sum(x.mixed_tokens for x in reports[0].values()) - 1) < 0.05


def test_subjects_are_learned_from_all_labelled_texts(spark):
    from quillspark.llm import subjects

    law, sport = "The zorkel was heard by the old quandle on a Monday. They wrote the fenmark and went home.", "The brillop ran to the green vastel on a Sunday. We saw the norgum and it was good."
    long = [(i, " ".join([law if i % 2 else sport] * 1600), "law" if i % 2 else "sport") for i in range(12)]
    assert all(len(t) > 1 << 17 for _, t, _ in long)
    plain = "There is little to be said about this. Others may think otherwise, but few people do so."
    rows = [*long, (20, law, None), (21, sport, None), (22, law, "nothing"), (23, plain, "energy"), (24, law, "sport"), (25, plain, None)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows + rows[:3]], "file_id bigint, text string")
    classes = spark.createDataFrame([(i, c) for i, _, c in rows], "file_id bigint, category string")
    parsed = subjects.parsed_texts(texts).distinct().join(classes.select("file_id", subjects.recorded_subject().alias("source")), "file_id", "left")
    labelled = [(t, subjects.SUBJECTS.index(c)) for _, t, c in rows if c in subjects.SUBJECTS]
    for a, b in zip(subjects.learn_from_table(parsed), subjects.learn(*zip(*labelled))):
        assert a.any() and (a == b).all()
    found = subjects.subject_findings(texts, classes).collect()
    assert len(found) == len(rows)
    got = {r.file_id: r.subject for r in found}
    assert [got[i] for i in (0, 1, 20, 21, 22, 23)] == ["sport", "law", "law", "sport", "law", "energy"]
