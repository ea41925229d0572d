"""Small tables with the awkward rows every operator has to stand."""

LONG = " ".join(f"word{i}" for i in range(30000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, ids string, shard string, node int"


def rows(texts, sources=("a", "b", None)):
    return [
        (i, t, None, sources[i % len(sources)], None, 7, "mine", "own", None, 1) for i, t in enumerate(texts)]


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, clashing names."""
    texts = [
        None, "", " \t\n", "one", "one two", "The cat sat on the mat", "the CAT sat  on the mat", LONG, LONG, "é ñ ß Ünder",
        "a\nb\nc\nd", "x\na\nb\nc", "a\nb\nc\nd", "mail bob@x.org now", "z" * 60000, "\n\n\n\n"]
    made = rows(texts)
    made += [made[5], made[5], (None, "no id", "en", None, 1, 1, None, None, None, None), (None, None) + (None,) * 8]
    return spark.createDataFrame(made, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
