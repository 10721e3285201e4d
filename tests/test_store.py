import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.config import LifecycleConfig
from tidewatch.operators import chain, evaluation, joins, lifecycle, ml, store

ALERT = "event_seq long, t_us long, incident_id string, score double, severity string, confidence double, calibrated_on string, event_count long, flows array<string>, evidence map<string,string>"


def test_lifecycle(spark):
    rows = [
        (0, 1_000_000, "a", 0.5, "MEDIUM", 0.5, "x", 2, ["f1"], {"k": "1", "only": "first"}), (1, 2_000_000, "a", 0.9, "HIGH", 0.4, "y", None, ["f2", "f1"], {"k": "2"}),
        (2, 3_000_000, "a", 0.1, "LOW", 0.5, "z", 0, None, None), (3, 2_500_000, "b", None, None, None, None, 1, [], {}),
    ]
    u = lifecycle.updates(spark.createDataFrame(rows, ALERT)).orderBy("event_seq").collect()
    assert [r.status for r in u] == ["NEW", "ACTIVE", "UPDATED", "NEW"] and [r.event_count for r in u] == [2, 3, 4, 1]
    assert [r.severity for r in u[:3]] == ["MEDIUM", "HIGH", "HIGH"] and [r.score for r in u[:3]] == [0.5, 0.9, 0.9]
    assert [(r.confidence, r.calibrated_on) for r in u[:3]] == [(0.5, "x"), (0.5, "x"), (0.5, "z")]
    assert u[1].flows == ["f1", "f2"] and u[1].evidence == {"k": "2", "only": "first"} and u[2].duration_s == 2.0
    i = lifecycle.incidents(lifecycle.updates(spark.createDataFrame(rows, ALERT)))
    done = {r.incident_id: r.status for r in lifecycle.resolved(i, 122_999_999, LifecycleConfig()).collect()}
    assert done == {"a": "UPDATED", "b": "RESOLVED"}
    assert [r.incident_id for r in lifecycle.most_recent(lifecycle.resolved(i, 122_999_999), 1).collect()] == ["a"]


def entries(spark, n=30):
    return spark.range(n).select(F.col("id").alias("order"), F.concat(F.lit("i"), "id").alias("incident_id"), F.lit("t").alias("last_observed"), F.sha2(F.col("id").cast("string"), 256).alias("payload_hash"))


@pytest.mark.parametrize("field,value,index,fault", [("payload_hash", "x", 10, "entry_hash"), ("seq", 3, 10, "sequence"), ("prev_hash", "y", 10, "prev_hash"), ("entry_hash", "z", 10, "entry_hash"), ("incident_id", None, 10, "missing_field")])
def test_chain_tampering_is_found(spark, field, value, index, fault):
    sealed = chain.sealed(entries(spark)).withColumn("index", F.col("seq") - 1)
    ok = chain.verified(sealed).first()
    assert (ok.valid, ok.entries, ok["index"]) == (True, 30, None)
    broken = sealed.withColumn(field, F.when(F.col("index") == 10, F.lit(value)).otherwise(F.col(field)))
    r = chain.verified(broken).first()
    assert (r.valid, r["index"], r.fault) == (False, index, fault)


def test_chain_omission_payload_and_resuming(spark):
    sealed = chain.sealed(entries(spark)).cache()
    gone = sealed.where("seq <> 11").withColumn("index", F.when(F.col("seq") > 11, F.col("seq") - 2).otherwise(F.col("seq") - 1))
    assert (chain.verified(gone).first()["index"], chain.verified(gone).first().fault) == (10, "prev_hash")
    wrong = chain.verified(sealed, recomputed=F.when(F.col("seq") == 5, "other").otherwise(F.col("payload_hash"))).first()
    assert (wrong["index"], wrong.fault) == (4, "payload")
    last = chain.latest(sealed).first()
    more = chain.sealed(entries(spark, 2), last.seq, last.entry_hash).orderBy("seq").first()
    assert (more.seq, more.prev_hash) == (31, last.entry_hash)
    assert chain.verified(sealed.limit(0)).first().valid
    p = spark.createDataFrame([('{"b": {"z": 1, "a": "é"}, "seq": 4, "a": 2}',)], "p string").select(chain.payload_hash(F.col("p"))).first()[0]
    assert p == hashlib.sha256(json.dumps({"a": 2, "b": {"a": "é", "z": 1}}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_store_reads_back_what_it_appends(spark, tmp_path):
    rows = [(1, "a", "NEW", 10, "t1"), (2, "b", "NEW", 11, "t2"), (3, "a", "ACTIVE", 12, "t3")]
    ledger = spark.createDataFrame(rows, "seq long, incident_id string, status string, last_us long, last_observed string").withColumn("created_at", F.col("last_us"))
    store.append(ledger.where("seq < 3"), f"{tmp_path}/l")
    store.append(ledger.where("seq = 3"), f"{tmp_path}/l")
    back = spark.read.parquet(f"{tmp_path}/l")
    assert {(r.incident_id, r.status, r.created_at) for r in store.snapshot(back).collect()} == {("a", "ACTIVE", 10), ("b", "NEW", 11)}
    page = store.incidents_page(store.snapshot(back), limit=0, offset=-5)
    assert [r.incident_id for r in page.collect()] == ["a"]
    assert [r.seq for r in joins.history_or_nothing(back, store.snapshot(back), "a").collect()] == [1, 3] and joins.history_or_nothing(back, store.snapshot(back), "zz").count() == 0
    e = spark.createDataFrame([("a", '{"x":1,"y":{"z":"q","w":null},"l":[1,2]}'), ("b", '{"m":2}')], "incident_id string, evidence string")
    t = store.export_table(e, ["incident_id"])
    assert t.columns == ["incident_id", "evidence.l", "evidence.m", "evidence.x", "evidence.y.w", "evidence.y.z"] or t.columns == ["incident_id", "evidence.l", "evidence.m", "evidence.x", "evidence.y.z"]
    store.write_csv(t, f"{tmp_path}/c")
    text = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("part-*.csv"))
    assert text.count(b"\r\n") >= 2 and b"[1,2]" in text


def test_ring_buffer(spark):
    held = spark.range(1000).select(F.concat(F.lit("i"), F.col("id")).alias("incident_id"), F.col("id").alias("seq"), F.lpad(F.col("id").cast("string"), 6, "0").alias("last_observed"))
    new = spark.range(50_000).select(F.concat(F.lit("i"), F.col("id") % 2000).alias("incident_id"), (F.col("id") + 1000).alias("seq"), F.lpad((F.col("id") + 1000).cast("string"), 6, "0").alias("last_observed"))
    r = store.merged_ring(held, new).collect()
    assert len(r) == 500 and r[0].seq == 50_999 and len({x.incident_id for x in r}) == 500


def test_attribution_prefers_the_last_of_the_class_then_the_first(spark):
    a = spark.createDataFrame([(1, "a", ["x"], 100, 100), (2, "b", ["x"], 100, 100), (3, "a", ["z"], 100, 100)], "alert_id long, letter string, ips array<string>, first_us long, last_us long")
    b = spark.createDataFrame([("L1", "c", ["x", "y"], 0, 200), ("L2", "a", ["x"], 10, 200), ("L3", "a", ["x"], 20, 200), ("L4", "a", ["x"], 5_000_101, 9e6)][:3], "attack_id string, letter string, key_ips array<string>, t_start long, t_end long")
    got = {r.alert_id: r.attack_id for r in joins.attributed(a, b).collect()}
    assert got == {1: "L3", 2: "L1", 3: None}


def test_reports(spark):
    p = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1), (1.0, 1)], "p double, y int")
    assert evaluation.roc_auc(p).first().auc == pytest.approx(5.5 / 6)
    assert evaluation.brier(p).first().brier == pytest.approx((0.01 + 0.16 + 0.36 + 0.01) / 5)
    assert {r.bin: r.n for r in evaluation.reliability(p).collect()} == {0: 1, 2: 2, 4: 2}
    assert evaluation.roc_auc(p.where("y = 1")).first().auc is None


def test_model_of_generated_names(spark, tmp_path):
    words = ["river", "stone", "cloud", "green", "paper", "light", "market", "garden", "silver", "window"]
    benign = [(f"{a}{b}.com", 0) for a in words for b in words if a != b][:80]
    odd = [(hashlib.sha256(str(k).encode()).hexdigest()[:14].translate(str.maketrans("0123456789", "qxzjkvwpfy")) + ".com", 1) for k in range(80)]
    df = spark.createDataFrame(benign + odd, "qname string, y int").withColumn("domain", F.col("qname"))
    model = ml.DgaModel.fit(df, trees=5)
    model.save(str(tmp_path / "m"))
    p = ml.DgaModel.load(spark, str(tmp_path / "m")).predict(spark.createDataFrame([("stonegarden.com",), ("zqxkvjwpzqxkvj.com",)], "qname string"))
    got = {r.qname: r.p for r in p.collect()}
    assert got["stonegarden.com"] < 0.5 < got["zqxkvjwpzqxkvj.com"]
    cal = spark.createDataFrame([("scan", k / 20, int(k > 9)) for k in range(20)] + [("c2", 0.5, 1)] * 3, "detector string, x double, truth int")
    fit = ml.calibrate_detectors(cal)
    assert set(fit) == {"scan"} and fit["scan"][0] > 0


def test_models_of_folds_and_the_trees_tasks(spark, monkeypatch):
    """One count gives each fold the model of the others' names, and the trees are grown by more tasks than there are classes, on the same three quarters as a window over each class gives."""
    rows = [(hashlib.sha256(str(k).encode()).hexdigest()[: 6 + k % 5] + ".com", int(k % 3 > 0)) for k in range(240)]
    df = spark.createDataFrame(rows, "qname string, y int").withColumn("domain", F.col("qname"))
    names = df.where("y = 0").select((F.length("qname") % 3).cast("long").alias("_fold"), F.substring("qname", 1, 6).alias("_name"))
    caught = []

    class Seen(Exception):
        pass

    class Pipeline:
        def __init__(self, stages):
            pass

        def fit(self, d):
            caught.append((d.select(F.spark_partition_id()).distinct().count(), {r.qname for r in d.collect()}))
            raise Seen

    monkeypatch.setattr(ml, "Pipeline", Pipeline)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(Seen):
            ml.DgaModel.fit(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    tasks, trained = caught[0]
    want = set()
    for y in (0, 1):
        own = sorted((q for q, v in rows if v == y), key=lambda q: hashlib.sha256(q.encode()).hexdigest())
        want |= {q for n, q in enumerate(own, 1) if n % 4}
    assert tasks > 2 and trained == want
    for k in range(3):
        alone = {(r.gram, r.p) for r in ml.language_model(names.where(F.col("_fold") != k), "_name").collect()}
        assert alone == {(r.gram, r.p) for r in ml.fold_models(names, "_name", 3).where(F.col("_fold") == k).collect()}


def test_every_row_has_its_place(spark):
    rows = [(k, k * 7919 % 1000 // 3) for k in range(1000)]
    got = {r.event_seq: r.place for r in store.placed(spark.createDataFrame(rows, "event_seq long, t_us long").repartition(5), "t_us", "event_seq").collect()}
    assert got == {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert store.placed(spark.createDataFrame([], "event_seq long, t_us long"), "t_us").count() == 0


def test_dga_model_query_fits_the_default_number_of_trees():
    import inspect

    from tidewatch.plans import source_queries

    assert "trees=" not in inspect.getsource(source_queries.dga_model)
    assert inspect.signature(ml.DgaModel.fit).parameters["trees"].default == 120


def test_evidence_of_any_depth_is_flattened(spark):
    deep = 41
    for k in range(12, 0, -1):
        deep = {f"l{k}": deep, "x": k}
    rows = [{"a": {"b": {"c": {"d": [1, {"e": 2}]}}}, "t": "{not an object", "u": '{"v": 1}'}, deep, {"empty": {}, "none": None, "dot.ted": {"k.l": True}}, {}]
    docs = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(9, None)], "id int, evidence string")
    got = {r.id: r.flat for r in store.flattened(docs, levels=3).collect()}
    assert got[0] == {"a.b.c.d": '[1,{"e":2}]', "t": "{not an object", "u": '{"v": 1}'}
    assert got[1]["l1.l2.l3.l4.l5.l6.l7.l8.l9.l10.l11.l12"] == "41" and len(got[1]) == 13
    assert got[2] == {"none": None, "dot.ted.k.l": "true"} and got[3] == {} and got[9] is None
    with pytest.raises(ValueError):
        store.export_table(docs, ["id"], most=3)


def test_names_are_looked_up_in_one_pass_and_trees_grow_in_as_many_tasks_as_cores(spark, monkeypatch):
    names = [f"{w}{k}.example" for k in range(40) for w in ("alpha", "lemon")] + [f"x{k * 7919:x}q{k}.info" for k in range(80)]
    df = spark.createDataFrame([(n, int(n.endswith(".info")), n) for n in names], "qname string, y int, domain string")
    scored = ml.lexical(df, ml.language_model(df.where("y = 0").withColumn("_name", F.split("qname", "[.]")[0]), "_name"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "rightHint=(strategy=broadcast)" in plan
    tasks, fit = [], ml.Pipeline.fit
    monkeypatch.setattr(ml.Pipeline, "fit", lambda self, rows: tasks.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("40", "false")):
            spark.conf.set(k, v)
        model = ml.DgaModel.fit(df, trees=2)
        assert len(tasks) == 2 and max(tasks) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    p = {r.y: r.p for r in model.predict(df).groupBy("y").agg(F.avg("p").alias("p")).collect()}
    assert p[1] > 0.9 > 0.1 > p[0]
