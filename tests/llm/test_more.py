"""Hits beside underscores, whole words of contexts, bounds of packing, rows of one id, and registered queries against SQL."""

import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, sharding, toxicity
from tessera.llm.queries import ORACLES, QUERIES


def test_hits_beside_underscores_and_digits():
    m = toxicity._ready(toxicity.Model(terms=["idiot"], stems=[], clean=frozenset(), weights=np.zeros(7), settings=toxicity.Settings()))
    for text in ("_idiot_", "idiot_", "1idiot", "an idiot!", "x\nidiot"):
        assert [(text.index("idiot"), text.index("idiot") + 5, 0)] == toxicity.hits_of(text, m, {}), text
    assert len(toxicity.hits_of("idiot idiot, _idiot", m, {})) == 3


def test_a_context_has_whole_words():
    low = "wonderful people said hello idiot goodbye everybody today"
    start = low.index("idiot")
    around, _ = toxicity.context(low, start, start + 5, 14)
    assert around == {"<said", "<hello", ">goodbye"}


@pytest.mark.parametrize("low, high", [(1100, 1101), (1025, 1501), (700, 701)])
def test_large_groups_are_packed_in_time(low, high):
    lengths = np.random.default_rng(1).integers(low, high, 20_000)
    began = time.time()
    bins = packing.pack(lengths, 2048)
    assert time.time() - began < 30 and len(bins) == packing.least_bins(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(20_000)) and all(lengths[b].sum() <= 2048 for b in bins)


def test_rows_of_one_id_are_dealt_over_chunks(spark):
    rows = spark.range(2_000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    out = sharding.assign_shards(rows, rows_per_chunk=2).groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert len(out) == 1 and out[0]["s"] == list(range(2_000))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_registered_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"create view {file.split('.')[0]} as select * from '{sf_dir}/{file}'")
    got, expected = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    plain = lambda df: sorted(tuple("" if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(expected)


def test_registered_queries_hold_rows_out(spark, sf_dir):
    import zlib

    for name, n, r in (("op4_language", 4, 2), ("op7_toxicity", 5, 0)):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % n == r) and 0 <= x["score"] <= 1 for x in rows)
    assert all(x["over_limit"] == (x["n_tokens"] > 4096) for x in QUERIES["op8_token_counts"](spark, sf_dir).collect())


def test_deep_pages_take_little_memory():
    import tracemalloc

    from tessera.llm.html import Page

    deep = "<div>" * 30_000 + "text of the page" + "</div>" * 30_000
    tracemalloc.start()
    page = Page(deep)
    assert page.text_at(page.best()) == "text of the page"
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    page = Page("<i>" * 8_000 + "<p>word" * 8_000 + "</p>" * 8_000)
    assert len(page.blocks) == 8_000


def test_paths_that_are_written_alike():
    from tessera.llm.html import Page

    page = Page("<article class='a&gt;b'><div class='c'><p>one</p></div></article><div class='d>e'><p>two</p></div>")
    for number in page.scores():
        assert page.text_at(page.path(number))
    assert page.text_at("") == "" and page.text_at(">nowhere") == ""
