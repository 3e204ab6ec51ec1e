"""Every query of the core: it runs, and gives the rows of its SQL."""

import os

import pytest
from compare import differences

from fabula.plans import catalog

FOLDER = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert differences(spark, FOLDER, QUERIES[name], SQL[name]) == []
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_core_does_not_import_the_subpackage():
    from pathlib import Path

    import fabula

    root = Path(fabula.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "fabula.llm" not in path.read_text(), path


def test_vocabularies_are_whole(spark):
    """The three sizes of the comparison, or all merges that the texts allow."""
    from fabula.plans import tokens

    folder = "/root/testdata/sf0.01"
    merges = QUERIES["bpe_merges"](spark, folder).count()
    more = len(tokens.bpe.learn_merges(QUERIES["chunk_counts"](spark, folder), 8192))
    assert merges == min(more, 8192 - 257)
    rows = sorted((r.vocabulary, r.tokens) for r in QUERIES["bytes_per_token"](spark, folder).collect())
    assert [v for v, _ in rows] == [min(v, merges + 257) for v in (2048, 4096, 8192)]
    assert [n for _, n in rows] == sorted((n for _, n in rows), reverse=True)
