"""Filtering stages judge every row by its own text, whatever its doc_id."""

from pyspark.sql import functions as F

import corpus_pipeline
from pixelmill.llm import decontaminate, near_copies, quality, simhash
from pixelmill.llm.common import NO_ID

SCHEMA = "doc_id long, text string, _id string, `a.b` string, c0 int, fp long, component long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "own", "own", 7, 8, 9) for i, t in rows], SCHEMA)


def seen(df):
    assert df.schema.simpleString() == table(df.sparkSession, []).schema.simpleString()
    rows = df.collect()
    assert all(tuple(r)[2:] == ("own", "own", 7, 8, 9) for r in rows)
    return sorted(((r.doc_id, r.text) for r in rows), key=repr)


def text(k):
    return " ".join(f"w{k}x{i * i}" for i in range(30))


def test_one_of_each_group(spark):
    rows = [(5, text(1)), (3, text(1)), (5, text(2)), (None, text(3)), (None, text(4)), (None, text(4)), (9, None), (8, ""), (None, "  "), (3, text(1)), (None, text(2))]
    kept = seen(simhash.one_of_each(table(spark, rows)))
    groups = {}
    for i, t in rows:
        key, order = simhash.fingerprint((t or "").encode()), NO_ID if i is None else i
        if key not in groups or order < groups[key][0]:
            groups[key] = (order, i, t)
    assert len(groups) == 5 and kept == sorted(((i, t) for _, i, t in groups.values()), key=repr)
    assert seen(simhash.one_of_each(table(spark, []))) == []


def test_ties_of_id_keep_one(spark):
    near = [(None, "one two three"), (None, "ONE two three"), (None, "one  two three")]
    assert len(seen(simhash.one_of_each(table(spark, near)))) == 1


def test_uncontaminated_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(1, item), (1, text(1)), (None, item), (None, text(2)), (None, None), (2, ""), (3, item + " " + " ".join(f"z{i}" for i in range(381))), (3, item + " " + " ".join(f"z{i}" for i in range(380)))]
    bench = spark.createDataFrame([("b", item), (None, None)], "item_id string, text string")
    kept = seen(decontaminate.uncontaminated(table(spark, rows), bench))
    assert kept == sorted([rows[1], rows[3], rows[4], rows[5], rows[6]], key=repr)
    assert seen(decontaminate.uncontaminated(table(spark, []), bench)) == []
    assert len(seen(decontaminate.uncontaminated(table(spark, rows), bench.where(F.lit(False))))) == len(rows)


def test_quality_rows(spark):
    rows = [(i, ("good words here, all of them fine. " if i % 2 else "#$% |||| !!!! ") * 5) for i in range(60)]
    odd = [(None, None), (1, ""), (1, rows[0][1]), (None, rows[1][1]), (3, "x" * 200_000), (1, rows[0][1])]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(4, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(table(spark, rows), labels)
    kept = seen(quality.accepted(table(spark, rows + odd), model))
    want = quality.score_with(table(spark, rows + odd).selectExpr("monotonically_increasing_id() doc_id", "text", "doc_id was"), model)
    assert len(kept) == want.where("predicted = 1").count() and {t for _, t in kept if t} >= {rows[1][1]} and rows[0][1] not in {t for _, t in kept}
    assert seen(quality.accepted(table(spark, []), model)) == []
    assert len(seen(corpus_pipeline.keep_quality(spark, table(spark, odd), "/root/testdata/sf0.001"))) <= len(odd)


def test_near_copy_rows(spark):
    rows = [(5, text(1)), (3, text(1)), (None, text(2)), (None, text(2)), (9, None), (8, " "), (3, text(3))]
    assert seen(near_copies.one_of_each(table(spark, rows))) == sorted([(3, text(1)), (None, text(2)), (8, " "), (3, text(3))], key=repr)
    assert seen(near_copies.one_of_each(table(spark, []))) == []


def test_private_rows(spark):
    rows = [(1, None), (None, ""), (1, text(1)), (1, text(1)), (None, text(1))]
    assert seen(corpus_pipeline.without_personal_data(spark, table(spark, rows), "")) == sorted(rows, key=repr)


def test_each_stage_first_gives_back_memory(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    from pixelmill.llm import common

    done = []
    monkeypatch.setattr(common, "shrink", lambda session: done.append("shrink"))
    for module, name in ((corpus_pipeline.quality, "fit"), (corpus_pipeline.quality, "accepted"), (corpus_pipeline.near_copies, "one_of_each"), (corpus_pipeline.decontaminate, "uncontaminated"), (corpus_pipeline.pii, "private"), (corpus_pipeline.bpe, "encode_decode")):
        monkeypatch.setattr(module, name, lambda *given, name=name: done.append(name))
    for name in ("labels", "benchmark"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        done.clear()
        stage(spark, spark.range(1), str(tmp_path))
        assert done[0] == "shrink" and len(done) > 1


def test_executors_collect_garbage_in_tasks_of_their_own(spark):
    from types import SimpleNamespace as Named

    from pixelmill.llm.common import shrink

    ran = []
    frame = Named(selectExpr=lambda text: Named(collect=lambda: ran.extend(spark.range(0, 6, 1, 6).selectExpr(text).collect())))
    context = lambda n: Named(_jsc=Named(sc=lambda: Named(getExecutorMemoryStatus=lambda: Named(size=lambda: n))), defaultParallelism=6)
    for n, rows in ((1, 0), (4, 6)):
        shrink(Named(sparkContext=context(n), range=lambda *given: frame))
        assert len(ran) == rows
