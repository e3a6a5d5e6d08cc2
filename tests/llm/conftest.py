import pytest
from llm_support import DOCS, SF

PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old tree by the river"


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(f"{w}{i % 97}" for i in range(30_000) for w in ("alpha", "beta"))
    return [
        (1, PROSE, "en", "a", 10),
        (2, PROSE, "en", "a", 10),
        (2, PROSE, "en", "a", 10),
        (3, "  The  quick\tbrown\nfox ", None, "b", None),
        (4, " The quick brown fox ", "en", None, 4),
        (5, "", "de", "b", 0),
        (6, None, None, None, None),
        (None, PROSE, "en", "a", 10),
        (None, None, None, None, None),
        (7, " \t\n ", "fr", "b", 3),
        (8, long_text, "en", "a", len(long_text)),
        (9, PROSE.replace("lazy", "crazy"), "en", "c", 10),
        (10, "élan vital!\nDöner macht  schöner \x1c Ende <|endoftext|> 12,5", "fr", "c", 3),
        (11, "x", "en", "c", 1),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with the awkward cases and extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), DOCS).repartition(3, "n_chars")
    clash = ["part", "row", "digest", "fp", "start", "score", "kept", "key", "shard", "level", "hits", "weight", "keep_id"]
    clash += ["_id", "_digest", "_n", "_start", "_source", "_pass", "_turn", "_own", "_place", "_key", "_hex", "_least", "_least_id", "_lang", "y", "id"]
    clash += ["of", "of_source", "pass", "n_tokens", "turn", "own", "place", "own_digest", "kept_id", "kept_digest", "least_id", "least_digest", "key_"]
    clash += ["n", "gone", "chosen_id", "root", "component_id", "block", "pair", "links", "body", "wanted", "term", "item", "rank", "document"]
    return df.withColumns({c: F.lit("extra") for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """All documents of the small test folder, in Python."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
