import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
CLASHING = "size long, shard string, fp string, ref long, spans long, block long, `rank` string, score string, seq long, tie long, bucket long, ids long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text), with columns whose names operators use inside."""

    def make(rows):
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
        return spark.createDataFrame([(i, t, None, None, None, *[None] * 12) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def messy():
    """Nulls, empty, blank, very long and repeated texts, equal ids and fully repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "the same text here and there again"), (6, "the same text here and there again"), (None, "a text without id"), (None, None), (7, "twice the same row"), (7, "twice the same row"), (8, "one id"), (8, "two texts"), (9, "\U0001f600 ÉÈ ß 日本語 x\x00y")]
