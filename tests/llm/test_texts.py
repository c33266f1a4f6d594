"""Text statistics, languages, subjects, levels and scans on small made-up texts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import language, scans, subjects
from quillspark.llm import textkind as K
from quillspark.llm.levels import reading_levels
from quillspark.llm.quality import quality_findings, text_stats

PROSE = "The committee asked about the lease and the offer was returned on time. It is not clear whether the form was complete."
CASES = {
    "prose": PROSE,
    "list": "\n".join(f"- deposit account no. {i}" for i in range(8)),
    "table": "Item;Ref;Sum\n" + "\n".join(f"loan;No. {i};{i}.50" for i in range(8)),
    "junk": "hzvy brxlmbqr zxdt lttwqzdh yfjspgx zqjzwhpn ljtg kgfcg yzhcjzgvl frwbdwpm",
}


@pytest.mark.parametrize("kind", CASES)
def test_kinds(kind):
    assert K.kind(K.whole(CASES[kind])) == kind
    assert K.kind(K.whole("")) == "" and K.kind(K.whole(" \n ")) == ""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n;|-5é\t", max_size=200), st.lists(st.integers(0, 200), max_size=6))
def test_summaries_do_not_depend_on_the_cuts(text, cuts):
    at = sorted({min(c, len(text)) for c in cuts} | {0, len(text)})
    parts = [text[a:b] for a, b in zip(at, at[1:])] or [""]
    s = K.Summary.of(parts[0])
    for p in parts[1:]:
        s = s.merge(K.Summary.of(p))
    assert s.close() == K.whole(text)


PARTS = ["word ", "a. ", "Mr. ", "x" * 90, "é" * 100, "-" * 90, "(" * 90, "." * 90, " .... ", " " * 40, "\t" * 20, "5" * 85, "don't ", "the ", "a; b, ", "Ã©" * 50, "Â 1 ", "- item ", "1) ", " > ", "\n", "z! ", "a" * 40 + "," * 60 + "b" * 40]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60), st.lists(st.integers(0, 4000), max_size=8), st.booleans())
def test_bounded_line_states_do_not_depend_on_the_cuts(parts, cuts, balanced):
    text, keep = "".join(parts) * 2, K.KEEP
    at = sorted({min(c, len(text)) for c in cuts} | {0, len(text)})
    pieces = [K.Summary.of(text[a:b]) for a, b in zip(at, at[1:])] or [K.Summary.of("")]
    try:
        K.KEEP = 100
        pieces = [K.Summary.of(text[a:b]) for a, b in zip(at, at[1:])] or [K.Summary.of("")]
        while balanced and len(pieces) > 1:
            pieces = [a.merge(b) for a, b in zip(pieces[::2], pieces[1::2])] + pieces[len(pieces) // 2 * 2 :]
        s = pieces[0]
        for p in pieces[1:]:
            s = s.merge(p)
        assert s.close() == K.whole(text)
    finally:
        K.KEEP = keep


@pytest.mark.parametrize("unit", ["plain words of a line, and so on. ", "x", "- ", " ", "col;", "Ж", "a\t", "Ã"])
def test_a_document_in_one_line_has_a_bounded_state(unit):
    text = unit * (400_000 // len(unit))
    parts = [K.Summary.of(text[i : i + 5000]) for i in range(0, len(text), 5000)]
    s = parts[0]
    for p in parts[1:]:
        s = s.merge(p)
        assert len(s.head.text) < 20_000
    assert s.close() == K.whole(text)
    assert len(s.head.text) <= 5 * K.KEEP or unit == "Ã"


TEXT = "file_id bigint, text string, kind string"


def test_long_texts_give_the_same_statistics_in_chunks(spark):
    t = spark.createDataFrame([(1, (PROSE + "\n") * 40, "x"), (2, "word " * 500, "x"), (3, "", None), (4, None, None), (5, "  \n ", None)], TEXT)
    names = ["file_id", "kind", "words", "marks", "chars", "lines"]
    whole = sorted(map(tuple, text_stats(t).select(*names).collect()))
    assert whole == sorted(map(tuple, text_stats(t, chunk_chars=97).select(*names).collect()))
    assert [r[0] for r in whole] == [1, 2]


def test_documents_of_megabytes_go_through_the_tree(spark):
    one_line = spark.range(1).selectExpr("7L AS file_id", "repeat('some plain words without any end, and so on ', 60000) AS text")
    lines = spark.range(1).selectExpr("8L AS file_id", f"repeat('{PROSE}\\n', 20000) AS text")
    out = {r.file_id: r for r in text_stats(one_line.unionByName(lines)).collect()}
    assert out[7].words == 540_000 and out[7].lines == 1 and out[7].marks == 0 and out[7].chars == 44 * 60_000
    n = len(PROSE.split())
    assert out[8].words == n * 20_000 and out[8].lines == 20_000 and out[8].kind == "prose" and out[8].ended_line_share == 1.0
    assert abs(out[8].mean_word_length - sum(map(len, PROSE.split())) / n) < 1e-9 and 0 < out[8].common_word_share < 1


def test_quality_findings(spark):
    n = len(PROSE.split())
    t = spark.createDataFrame([(1, PROSE, ""), (1, PROSE, ""), (2, CASES["list"], ""), (3, PROSE, ""), (4, PROSE, "")], TEXT)
    score = K.readability(K.whole(PROSE))
    m = spark.createDataFrame([(1, n, score, "a"), (3, None, float("nan"), "a"), (4, n + 1, score + 0.4, "a")], "file_id bigint, word_count bigint, readability_score double, text string")
    assert {tuple(r) for r in quality_findings(t, m).collect()} == {(2, "list"), (3, "word_count"), (3, "readability"), (4, "word_count")}
    assert quality_findings(t.limit(0), m.limit(0)).count() == 0


WORDS = {
    "en": "the committee asked about the offer and it was returned without delay because the figures did not match",
    "de": "die Frist wurde nach der letzten Sitzung verschoben weil die Rechnung noch nicht geprüft worden ist",
    "fr": "le contrat de bail a été comparé avant les vacances car le jugement manquait encore dans le dossier",
    "es": "el plazo de recurso no se ha revisado porque todavía faltaba la sentencia en el archivo del edificio",
    "it": "la clausola di garanzia non è ancora disponibile perché la sentenza si trova nella nostra filiale",
    "pt": "a procuração ainda não chegou porque a sentença está guardada no arquivo e não foi pedida antes",
}


@pytest.fixture(scope="module")
def weights():
    texts, labels, rng = [], [], np.random.default_rng(1)
    for lang, s in WORDS.items():
        for _ in range(20):
            texts.append(" ".join(rng.permutation(s.split())))
            labels.append(lang)
    return language.fit(texts, labels)


def test_languages(weights):
    p = language.Presence()
    found = language.documents_languages(list(WORDS.values()), weights, p)
    assert [f[0][:2] for f in found] == [(0, x) for x in WORDS]
    mixed = WORDS["de"] + "\n\n17\n\n" + WORDS["it"]
    assert [x[:2] for x in language.documents_languages([mixed], weights, p)[0]] == [(1, "de"), (3, "it")]
    assert all(0 <= x[2] <= 1 for x in found[0])


def test_confidences_are_calibrated():
    rng, texts, labels = np.random.default_rng(2), [], []
    for lang, s in WORDS.items():
        for _ in range(30):
            texts.append(" ".join(rng.permutation(s.split())))
            labels.append(lang)
    order = rng.permutation(len(texts))
    scale = language.fit_scale([texts[i] for i in order], [labels[i] for i in order])
    assert scale in language.CONFIDENCE_SCALES
    assert language.confidence(np.array([1.0, 0.0]), 1.0) < language.confidence(np.array([1.0, 0.0]), 4.0) < 1
    assert language.fit_scale([], []) in language.CONFIDENCE_SCALES


def test_presence_is_a_set(weights):
    p = language.Presence()
    a, b = p.ids("banana banana"), p.ids("banana banana banana")
    assert len(set(a)) == len(a) and set(a) == set(b)
    assert len(p.ids("")) == 0 and len(p.ids("7")) == 0


def test_label_codes(spark):
    from pyspark.sql import functions as F

    rows = ["en-GB", "English", "DEU", "pt_BR", "xx", "", None, "mul", " fr-CH "]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, l string")
    assert [r.c for r in d.orderBy("i").select(language.label_code(F.col("l")).alias("c")).collect()] == ["en", "en", "de", "pt", None, None, None, None, "fr"]


def test_subjects_of_paragraphs():
    law, sport = "The court heard the appeal. The lease contract has a clause. The witness came.", "The referee saw the match. The club won the league. The stadium was full."
    texts, labels = [law] * 10 + [sport] * 10, [subjects.SUBJECTS.index("law")] * 10 + [subjects.SUBJECTS.index("sport")] * 10
    w = np.concatenate([*subjects.learn(texts, labels), subjects.seed_weights()], axis=1)
    votes = subjects.paragraph_votes([law + "\n\n" + sport, law, "nothing known"], w, subjects.Buckets())
    accuracy, prior = np.array([0.9, 0.95, 0.9, 0.3, 0.3, 0.7]), np.full(8, 1 / 8)
    names = [[subjects.SUBJECTS[s] for s, _ in subjects.document_subjects([p * 9 for p, _ in v], [n for _, n in v], subjects.Posteriors(accuracy, prior))] for v in votes]
    assert sorted(names[0]) == ["law", "sport"] and names[1] == ["law"] and len(names[2]) == 1


def test_accuracies_are_learned():
    rng, patterns = np.random.default_rng(0), {}
    for _ in range(4000):
        y, p = rng.integers(8), 0
        for a in (0.95, 0.9, 0.85, 0.2, 0.2, 0.6):
            v = y if rng.random() < a else rng.integers(8)
            p = p * 9 + v + 1
        patterns[p] = patterns.get(p, 0) + 1
    accuracy, _ = subjects.learn_accuracies(np.array(list(patterns)), np.array(list(patterns.values()), float))
    assert accuracy[0] > 0.9 and accuracy[3] < 0.4 and 0.5 < accuracy[5] < 0.75


def test_levels_held_out(spark):
    easy, hard = "put the red box on the shelf. we saw a big car.", "the heterogeneous modality presupposes normative indeterminacy."
    docs = [(i, (easy if i % 2 else hard) + f" number {i}", "z") for i in range(80)] + [(100, None, "z"), (101, "", "z")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, reading_level string")
    s = spark.createDataFrame([(i, 1 if i % 2 else 4) for i in range(20)], "doc_id bigint, reading_level bigint")
    out = {r.doc_id: r.reading_level for r in reading_levels(d.unionByName(d), s).collect()}
    assert all((out[i] <= 2) == bool(i % 2) for i in range(20, 80)) and out[100] == 2 and out[101] == 2 and len(out) == 82


SCAN = "ACME WATER TRUST — REPORT\n\nThe committee has asked about the inv-\noice and the part-\ntime staff of the orga-\n\n- 1 -\nACME WATER TRUST — REPORT\nnisation. It was kept in the rec0rds room\nuntil the review board had returned it to\nthe ofﬁce.\n\nPage 2 / 2"


@pytest.fixture(scope="module")
def lex():
    words = "the committee has asked about invoice and part-time staff of organisation it was kept in records room until review board had returned to office".split()
    return scans.Lexicon({w: 500 for w in words}, 20_000)


def test_scan_faults(lex):
    found = {(n, k, f) for n, k, f, _ in scans.faults(SCAN, lex)}
    assert found == {
        (1, "furniture", ""), (7, "furniture", ""), (8, "furniture", ""), (13, "furniture", ""),
        (3, "hyphen", "invoice"), (4, "hyphen", "part-time"), (5, "hyphen", "organisation"), (9, "misread", "records"), (11, "misread", "office"),
    }
    assert scans.faults("", lex) == [] and scans.faults("one line only", lex) == []


def test_repair(lex):
    out = scans.repair(SCAN, lex)
    assert "—" not in out and "invoice" in out and "part-time" in out and "organisation." in out and "records room" in out and "\n\n" not in out
    assert scans.repair("no scan at all", lex) == "no scan at all"


def test_words_split_and_merged(lex):
    assert scans.split_or_merged(["thecommittee", "has", "inv", "oice"], lex) == ["the", "committee", "has", "invoice"]


def test_misread_words_do_not_depend_on_size_or_copies(spark, lex):
    for times in (1, 1000):
        large = scans.Lexicon({w: n * times for w, n in lex.counts.items()} | {"period": 500 * times, "pcriod": 5 * times}, 20_000 * times)
        assert scans.misread("pcriod", large) == ("period", [])
    wide = SCAN.replace("rec0rds room", "pcriod room")
    plain = " ".join(["the period"] * 60)
    rows = [(1, plain), (2, wide), (3, wide)] + [(i, wide) for i in range(4, 300)]
    found = scans.scan_faults(spark.createDataFrame(rows, "file_id bigint, text string"))
    assert {r.file_id for r in found.filter("kind = 'misread' and fixed = 'period'").collect()} == set(range(2, 300))


RARE = "ACME WATER TRUST — REPORT\n\nThe committee has asked about the quill-\nboard and the forms of the zarn6odal\nrecords of the pcriad that was kept in it.\n\nPage 2 / 2"


@pytest.mark.parametrize("top", [300_000, 12])
def test_rare_words_are_decided_by_the_join_in_both_queries(spark, monkeypatch, top):
    monkeypatch.setattr(scans, "TOP_WORDS", top)
    common = " ".join(["the committee has asked about of and forms records that was kept in it"] * 9)
    rows = [(1, RARE), (2, common), (3, "a quill-board here"), (4, "the zarnbodal"), (5, "a periad, " * 40)]
    d = spark.createDataFrame(rows, "file_id bigint, text string")
    found = {(r.kind, r.fixed) for r in scans.scan_faults(d.unionByName(d)).collect() if r.kind != "furniture"}
    assert found == {("hyphen", "quill-board"), ("misread", "zarnbodal"), ("misread", "periad")}
    repaired = {r.file_id: r.repaired for r in scans.repaired_texts(d).collect()}
    assert "the quill-board and" in repaired[1] and "the zarnbodal records of the periad that" in repaired[1] and repaired[2] == common


def test_one_path_decides_split_merged_and_misread_together(lex):
    page = "ACME WATER TRUST — REPORT\n\nThe committee has asked about thecornmittee\nrecords that were kept in the inv oicc\nroom until the review board had retu\nrned to the office.\n\nPage 2 / 2"
    lex = scans.Lexicon({w: 20_000 for w in lex.counts}, 2_000_000)
    found = {(n, f) for n, k, f, _ in scans.faults(page, lex) if k == "misread"}
    assert found == {(3, "committee"), (4, "invoice")}
    assert "about the committee records" in scans.repair(page, lex) and "the invoice room" in scans.repair(page, lex) and "had returned to" in scans.repair(page, lex)
    assert scans.split_or_merged(["it", "was", "kept"], lex) == ["it", "was", "kept"]
