"""quillspark: a Spark-native engine that profiles, cleans, classifies and organises document collections."""
