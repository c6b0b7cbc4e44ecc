"""Every registered query of the operators on the smallest tables, against its SQL where there is one, and the pipeline."""

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from keelson.llm import html, jaccard, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def docs(tables):
    return dict(tables.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    result = tables.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())


def test_packing_of_the_table(spark, docs):
    rows = QUERIES["op2_best_fit_packing"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(r.length for r in rows)
    assert len(by) <= 1.02 * -(-total // 2048)


def test_toxicity_of_the_table(spark, tables, docs):
    rows = QUERIES["op4_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_fingerprints_of_the_table(spark, docs):
    rows, order = QUERIES["op5_fingerprints"](spark, SF).collect(), sorted(docs)
    for r in rows:
        t, after = docs[r.doc_id], docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        m = len(t) // 4
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest())
    prints = {}
    for r in rows:
        prints.setdefault(r.fingerprint, set()).add(tuple(sorted(docs[r.doc_id].split("\n"))))
    assert all(len(x) == 1 for x in prints.values())


def test_bpe_of_the_table(spark, docs):
    with open(public_tokenizers.path(queries.BYTE_BPE), "rb") as lines:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op8_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_html_of_the_table(spark, tables):
    pages = dict(tables.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall())
    rows = QUERIES["op9_html_extraction"](spark, SF).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:  # no host here puts a text into half of its articles
        assert r.text == "\n".join(b.text for b in html.blocks_of(pages[r.page_id]) if not b.template and b.main == 2)
        assert r.n_chars == len(r.text)


def test_personal_data_of_the_table(spark, docs):
    from test_operators import _base

    for r in QUERIES["op10_pii"](spark, SF).collect():
        base = _base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert r.n_spans == len(r.spans.split(",") if r.spans else []) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_pipeline_runs_as_its_stages_one_by_one(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    start = spark.read.parquet(f"{SF}/documents.parquet")
    kept = toxicity.clean(start, spark.read.parquet(f"{SF}/labels.parquet"))
    parts = jaccard.jaccard_components(kept).collect()
    assert {r.doc_id for r in rows} == {r.component_id for r in parts}
    safe = pii.sanitize(jaccard.keep_one(kept))
    want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.pack(spark, safe, SF).collect()}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows} == want


def test_stages_with_nulls_repeats_and_other_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None, "x", 1, 7), (2, "", "x", 1, 7), (3, text, "x", 1, 7), (3, text, "x", 1, 8), (4, text, None, None, 7), (None, text, "x", 1, 7), (5, "mail a@b.cc " * 3, "x", 1, 7), (5, "an other text of the same id altogether", "x", 1, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, component_id int")
    safe = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, safe, SF)
        assert found.columns == table.columns, name
        assert stage(spark, table.limit(0), SF).count() == 0
        if name == "toxicity":  # these ids' labels belong to other texts
            assert {r.doc_id for r in found.collect()} <= {1, 2, 3, 4, 5, None}
        else:
            safe = found
    got = sorted((r.doc_id or 0, r.text) for r in safe.select("doc_id", "text").collect())
    assert got == [(0, text), (1, None), (2, ""), (3, text), (5, "an other text of the same id altogether"), (5, "mail [EMAIL] mail [EMAIL] mail [EMAIL] ")]
    packed = corpus_pipeline.pack(spark, safe, SF)
    assert packed.count() == 6 and corpus_pipeline.pack(spark, table.limit(0), SF).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.score(table.limit(0), toxicity.learn(table, labels)).count() == 0
