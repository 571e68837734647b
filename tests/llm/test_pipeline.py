"""Each stage against a brute-force version of itself, on its own input, and the stages run on from one another."""
import corpus_pipeline as P
import pytest
from conftest import SCHEMA, words
from pyspark.sql import functions as F

from test_linededup import brute as brute_lines
from test_mixing import brute_copies
from test_neardup import brute as brute_near
from test_packing import check as check_pack


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A corpus with junk, a line that many documents share, copies and near copies."""
    rows = []
    for i in range(60):
        rows.append((i, words(i, 80) + "\nthe same line in many documents\n" + words(200 + i, 30), "en" if i % 3 else "de", f"src{i % 4}", 1))
    rows += [(100 + i, words(7, 90), "en", "src0", 1) for i in range(9)]
    near = words(7, 90).split()
    near[3] = "other"
    rows += [(120, " ".join(near), "en", "src1", 1), (130, "spam " * 200, "en", "src0", 1), (131, "too short", "en", "src0", 1), (132, None, None, None, None), (133, "", "de", "src2", 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "packing"]
    inputs = []
    for k, (_, stage) in enumerate(P.STAGES):
        inputs.append([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()])
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
    final = out.collect()

    def base_ok(t):
        w = (t or "").split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {j for i, x in enumerate(g) if g.count(x) > 1 for j in (i, i + 1, i + 2)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    assert sorted(inputs[1]) == sorted(r for r in inputs[0] if base_ok(r[1]))  # few labels certify no rule
    lines = brute_lines([r[:2] for r in inputs[1]], 10, True)
    want = {i: t for i, t, _, dropped in lines if t.strip() or not dropped}
    assert {r[0]: r[1] for r in inputs[2]} == want and len(inputs[2]) == len(want)
    kept = {i for i, _, _, keep in brute_near([r[:2] for r in inputs[2]]) if keep}
    assert {r[0] for r in inputs[3]} == kept and 100 in kept and 120 not in kept
    rows = [(i, len(t.split()), (("forum" if s[-1] < "5" else "press"), lang, s)) for i, t, lang, s in inputs[3]]
    leaves, tokens = {}, sum(n for _, n, _ in rows)
    for _, n, p in rows:
        leaves[p] = leaves.get(p, 0) + n
    from churnspark.llm.mixing import leaf_budgets
    frame = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "domain string, language string, source string, tokens long")
    budgets = {(r["domain"], r["language"], r["source"]): r["budget"] for r in leaf_budgets(frame, int(P.MIX_SHARE * tokens), P.MIX_WEIGHTS, 1).collect()}
    assert sorted(str(r[0]) for r in inputs[4]) == sorted(i for i, _, c in brute_copies(rows, budgets, 7) if c)
    check_pack([r[:2] for r in inputs[4]], final, 4096)
    key = lambda r: (r["doc_id"], r["start"], r["ids_crc32"])
    assert sorted(map(key, P.run(spark, sf).collect())) == sorted(map(key, final))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_user_columns_come_through_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = {"row_key": "mine", "n_lines": 7, "n_dropped": 8, "kept": False, "domain": "dom", "tokens": 99, "copies": 5, "id": 3, "component": 4, "other_columns": "x"}
    mine = docs.withColumns({k: F.lit(v) for k, v in clash.items()})
    for _, stage in P.STAGES[:4]:
        out = stage(spark, mine, sf)
        assert out.columns == mine.columns
        rows = out.collect()
        assert rows and all(r[k] == v for r in rows for k, v in clash.items())
        assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(str(tuple(r)) for r in stage(spark, docs, sf).collect())


def test_used_results_are_removed(spark, sf):
    from churnspark.session import ensure_checkpoint_dir
    path = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def stages():
        return sorted(str(s.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().startswith("pipeline-") for s in fs.listStatus(f.getPath()))

    before = stages()
    assert P.run(spark, sf).count() and len(stages()) == len(before) + 1
