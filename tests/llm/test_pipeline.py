"""The pipeline and the registered queries."""

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodestone.llm import queries, secrets, sentencepiece_table
from tests.llm.test_operators import brute_groups, brute_overlaps, brute_stats, prose, ws

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(*names).collect()) == sorted(str(r) for r in want.fetchall())


def test_pipeline(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) < len(docs) and len({r.doc_id for r in out}) == len(out)
    assert all(r.n_tokens == len(r.ids) and r.ids[0] == 1 and r.ids[-1] == 2 for r in out)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "secret redaction", "token ids"]
    assert "pipeline" in entry.queries() and {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


def brute_pipeline(docs, items):
    """doc_id and ids of what is left, in order: rules, one row of each near-duplicate group, no benchmark passage, no base span, then the library's ids."""
    import sentencepiece

    def good(t):
        n, chars, symbols, dup, repeated = brute_stats(t)
        lines = [x for x in t.split("\n") if ws(x)]
        upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
        return n >= 50 and 2 * repeated <= n and 10 * symbols <= n and 2 * dup <= len(lines) and upper <= lower and 2 * n <= chars <= 20 * n

    kept = [(d, t) for d, t in docs if good(t or "")]
    group = {d: c for d, _, c in brute_groups(list(enumerate(t for _, t in kept)), 5, 80)}
    ids = [d for d, _ in kept]
    first = {}
    for k in range(len(kept)) if None in ids or len(set(ids)) < len(ids) else sorted(range(len(kept)), key=lambda k: ids[k]):
        first.setdefault(group[k], k)
    kept = [kept[k] for k in sorted(first.values())]
    hit = {k for k, i in brute_overlaps([(k, t) for k, (_, t) in enumerate(kept)], items) if len(dict(items)[i].split()) >= 4}
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_table.default_model())
    clean = [(d, secrets.redact_text(t, secrets.base_spans(t))) for k, (d, t) in enumerate(kept) if k not in hit]
    return sorted(str((d, [1, *sp.encode(t), 2])) for d, t in clean)


@pytest.mark.parametrize("own_ids", [True, False])
def test_pipeline_equals_brute_force(spark, tmp_path, own_ids):
    """Copies, passages, secrets, nulls, null and repeated ids, columns with clashing names; then an empty table."""
    r = random.Random(17)
    base = [prose(r.randint(55, 120), 100 + k) for k in range(12)]
    items = [(1, prose(20, 300)), (2, prose(5, 301)), (3, prose(9, 302)), (4, "the a")]
    near = base[1].split()
    near[30] = "changed"
    part = items[0][1].split()
    part[7] = "swapped"
    texts = [*base, base[0], base[0], " ".join(near), f"{prose(60, 200)} {' '.join(part)} {prose(30, 201)}", f"{prose(60, 202)} {items[1][1]} {prose(9, 203)}", f"{items[2][1]} {prose(70, 204)}", f"{prose(70, 205)} the a {prose(5, 206)}", None, "", " \n", prose(10, 207)]
    texts += [f"{prose(60, 208)} password = \"b7db7aa4a5fcc7830599\" {prose(40, 209)}", prose(60, 210).upper(), "a b c " * 40, f"{prose(3000, 211)}", base[3]]
    ids = [7 * k % 101 for k in range(len(texts))]
    if not own_ids:
        ids[0] = ids[13] = ids[5] = None
        ids[4] = ids[6] = ids[20] = 9
    rows = [(d, t, "xx", "s", len(t or ""), True, 5, [1], "w", 0.5) for d, t in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rejected boolean, n_tokens long, ids array<int>, words string, window double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str((x.doc_id, x.ids)) for x in got) == brute_pipeline(list(zip(ids, texts, strict=True)), items)
    for k in range(4):
        stage = corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert stage.columns == [x.split()[0] for x in schema.split(", ")]
    if own_ids:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
