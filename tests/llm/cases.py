"""Awkward documents shared by the operators' tests."""

LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(30_000))
CLASH = ["rank", "length", "task", "n_tokens", "id", "kept", "score", "component_id"]


def awkward(spark, texts=None):
    """Nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    texts = texts if texts is not None else [None, "", " \n\t ", "a", "a", "!!!", "12 34", LONG, LONG, "the cat sat on the mat"]
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, *[7] * len(CLASH)) for i, t in enumerate(texts)]
    rows += [(None, "row without an id", None, None, None, *[7] * len(CLASH)), rows[-1], rows[-1]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASH))


def nothing(spark):
    return awkward(spark).limit(0)
