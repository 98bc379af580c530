"""The stages against brute force on the smallest tables, and the queries against SQL."""

from __future__ import annotations

import hashlib
import re
import struct

import pandas as pd
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from glyphsweep.llm import bpe, near_dedup, quality
from glyphsweep.llm.common import table
from glyphsweep.llm.queries import ORACLE, QUERIES, vocabulary_path
from tests.compare import connect, differences
from tests.llm.test_near_dedup import brute as near_classes
from tests.llm.test_operators import brute_contamination

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) < set(driver.queries()) and "pipeline" in driver.queries()
    assert sorted({int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES}) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    good = {r.doc_id: r.text for r in quality.keep_good(docs, table(spark, SF, "labels")).collect()}
    assert 0.6 * docs.count() < len(good) < docs.count()
    first: dict[str, int] = {}
    for key in sorted(good):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", good[key] or ""), key)
    exact = {k: good[k] for k in first.values()}
    near = {k: exact[k] for k, root in near_classes(exact).items() if k == root}
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    clean = {k: near[k] for k, found in brute_contamination(near, items).items() if not found[3]}
    library = Tokenizer.from_file(vocabulary_path())
    want = {}
    for k, t in clean.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[k] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_tasks_leave_no_words_in_their_processes(spark):
    """Processes are used again by the stages that follow: what each remembered would add up."""
    docs = spark.range(4_000).selectExpr(
        "id AS doc_id", "concat_ws(' ', 'word', md5(cast(id AS string)), sha1(cast(id AS string)), 'a few words more of', id % 900) AS text").repartition(8)
    labels = spark.range(4_000).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS quality")
    kept = near_dedup.drop_near_copies(quality.keep_good(docs, labels, threshold=0.0))
    assert bpe.encode_documents(kept, vocabulary_path()).count() == kept.count()
    bpe.encode_documents(docs, vocabulary_path()).write.format("noop").mode("overwrite").save()

    def held(batches):
        for _ in batches:
            pass
        yield pd.DataFrame({"n": [len(quality._shape_ids) + len(near_dedup._word_hashes) + len(bpe.vocabulary(vocabulary_path()).known)]})

    assert spark.range(0, 64, 1, 16).mapInPandas(held, "n long").agg({"n": "max"}).first()[0] == 0
