import pytest

TABLE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text) or fuller rows; n_chars follows the text."""

    def build(rows, extra=()):
        full = []
        for r in rows:
            doc_id, text, *more = r
            lang, source = (*more, None, None)[:2]
            full.append((doc_id, text, lang, source, len(text) if text is not None else None, *[7 for _ in extra]))
        return spark.createDataFrame(full, TABLE + "".join(f", `{e}` bigint" for e in extra))

    return build


@pytest.fixture
def odd(make):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and clashing extra columns."""
    rows = [
        (1, "one two three four five six seven eight", "en", "a"), (2, None, "en", None), (None, "no id at all here", None, "a"), (3, "", None, None), (4, " \t\n ", "fr", "b"),
        (5, "word " * 60000, "en", "a"), (6, "one  two three\tfour five six seven eight", "en", "b"), (1, "one two three four five six seven eight", "en", "a"),
        (7, "x" * 200000, None, "c"), (8, "ééé ßßß 日本 ~~ 123", "de", "c"), (9, "...", "en", "a"), (None, None, None, None),
    ]
    return make(rows, ("_sha", "kept", "shard", "_doc", "score", "key", "rep", "row", "_gone"))
