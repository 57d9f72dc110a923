"""Day tiles, activity sketches, and the boosted model checked by hand."""

import re

import pytest
from pyspark.sql import functions as F

from etaforge.operators.accuracy import regression_metrics
from etaforge.plans import features as feats
from etaforge.plans import materialize, model, scoring, tiles
from etaforge.session import scratch_dir, write_through
from etaforge.sources import commerce, history
from test_history import plan

SF = "/root/testdata/sf0.01"
DAYS = ("2000-04-30", "2000-06-10")


@pytest.fixture(scope="module")
def past(spark):
    path = scratch_dir(spark, "t-history")
    rows = commerce.orders(spark, SF).where(F.col("delivered_at").between(F.lit("2000-04-25"), F.lit("2000-06-20")))
    history.write_history(rows, path, "day", splits=1)
    return history.read_history(spark, path)


@pytest.fixture(scope="module")
def store_tiles(spark, past):
    path = scratch_dir(spark, "t-tiles")
    tiles.refresh_tiles(past, "store_id", *DAYS, path)
    return path


def as_rows(df, *extra):
    cols = ["store_id", F.round("avg_delivery_minutes", 6), "order_count", *extra]
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("as_of", ["2000-06-01 00:00:00", "2000-06-02 06:30:15", "2000-05-31 23:59:59"])
def test_tiles_give_the_snapshot(spark, past, store_tiles, as_of):
    found = tiles.read_tiles(spark, store_tiles, "store_id")
    got = tiles.snapshot_from_tiles(found, past, "store_id", as_of)
    want = materialize.entity_snapshot(commerce.orders(spark, SF), "store_id", as_of)
    assert as_rows(got) == as_rows(want) != []


def test_next_day_reads_that_day_only(spark, past, store_tiles):
    found = tiles.read_tiles(spark, store_tiles, "store_id")
    second = tiles.snapshot_from_tiles(found, past, "store_id", "2000-06-02 06:30:00")
    text = plan(second)
    days = re.findall(r"PartitionFilters: \[([^\]]*day[^\]]*)\]", text)
    assert any(">= 2000-05-04" in d and "<= 2000-06-01" in d for d in days)  # 29 whole days of tiles
    edges = re.findall(r"PartitionFilters: \[([^\]]*delivered_period[^\]]*)\]", text)
    assert len(edges) == 2  # the two cut days, each from its own folders
    assert ">= 2000-05-03" in edges[0] and "<= 2000-05-04" in edges[0] and ">= 2000-06-02" in edges[1]
    at_midnight = tiles.snapshot_from_tiles(found, past, "store_id", "2000-06-02 00:00:00")
    assert "delivered_period" not in plan(at_midnight)  # tiles alone


def test_refreshing_a_day_takes_in_its_late_deliveries(spark, past, store_tiles, tmp_path):
    path = str(tmp_path / "tiles")
    part = past.where("not (to_date(delivered_at) = '2000-05-20' and order_id % 2 = 0)")
    tiles.refresh_tiles(part, "store_id", *DAYS, path)
    want = tiles.read_tiles(spark, store_tiles, "store_id")
    assert want.exceptAll(tiles.read_tiles(spark, path, "store_id")).count() > 0
    before = {f.name: f.stat().st_mtime_ns for d in (tmp_path / "tiles").glob("day=*") if d.name != "day=2000-05-20" for f in d.iterdir()}
    tiles.refresh_tiles(past, "store_id", "2000-05-20", "2000-05-20", path)
    after = {f.name: f.stat().st_mtime_ns for d in (tmp_path / "tiles").glob("day=*") if d.name != "day=2000-05-20" for f in d.iterdir()}
    assert before == after
    back, round6 = tiles.read_tiles(spark, path, "store_id"), F.round("minutes", 6).alias("minutes")
    cols = ["store_id", "n", "nv", round6, "day"]
    assert back.select(*cols).exceptAll(want.select(*cols)).isEmpty() and want.count() == back.count()


def test_merged_sketches_stay_within_their_error(spark, tmp_path):
    """100,000 customers over 40 days: three standard errors of 1.6 %."""
    rows = spark.range(400_000).select(
        (F.col("id") % 37).alias("store_id"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("customer_id"),
        F.timestamp_seconds(F.lit(946684800) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40 * 86_400))).alias("delivered_at"),
    )
    path = str(tmp_path / "activity")
    tiles.refresh_activity(rows, "2000-01-01", "2000-02-09", path)
    ends, windows = ["2000-01-20", "2000-02-10"], (1, 7, 30)
    got = {(str(r["as_of_day"]), r["window_days"]): r for r in tiles.active_entities(tiles.read_activity(spark, path), ends, windows).collect()}
    assert len(got) == 6
    for end in ends:
        for days in windows:
            inside = rows.where((F.col("delivered_at") < F.lit(end)) & (F.col("delivered_at") >= F.date_sub(F.lit(end).cast("date"), days)))
            exact = inside.agg(F.countDistinct("customer_id"), F.countDistinct("store_id")).first()
            assert abs(got[end, days]["customers"] - exact[0]) <= 0.05 * exact[0]
            assert got[end, days]["stores"] == exact[1] == 37


# --- the model -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark):
    t = commerce.tables(spark, "/root/testdata/sf0.001")
    rows = write_through(model.with_split(feats.training_features(t)), "t-training")
    return rows, model.fit(rows.where(~F.col("is_test")), maxIter=12, maxDepth=3)


def tree_nodes(tree):
    """Nodes of one tree, walked in Python: (feature, threshold, left, right) or a prediction."""
    def node(n):
        if n.numDescendants() == 0:
            return n.prediction()
        return n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild())

    return node(tree._call_java("rootNode"))


def walked(node, x):
    while isinstance(node, tuple):
        feature, threshold, left, right = node
        node = left if x[feature] <= threshold else right
    return node


def test_scores_are_the_walked_trees(spark, fitted):
    rows, m = fitted
    gbt = m.stages[-1]
    trees = [tree_nodes(t) for t in gbt.trees]
    sample = model.predict(m, rows).limit(200).collect()
    for r in sample:
        x = [-1.0 if r[f] is None else float(r[f]) for f in scoring.MODEL_FEATURES]
        want = sum(w * walked(t, x) for w, t in zip(gbt.treeWeights, trees, strict=True))
        assert r["predicted_delivery_minutes"] == pytest.approx(want, abs=1e-9)


def test_importance_is_the_mean_gain_of_the_trees(spark, fitted):
    """Recomputed from the nodes: gain times rows per feature over all trees, as shares."""
    _, m = fitted
    total = [0.0] * len(scoring.MODEL_FEATURES)

    def add(n, own):
        if n.numDescendants():
            own[n.split().featureIndex()] += n.gain() * n.impurityStats().count()
            add(n.leftChild(), own), add(n.rightChild(), own)

    for tree in m.stages[-1].trees:
        add(tree._call_java("rootNode"), total)
    got = {r["feature"]: r["importance"] for r in model.feature_importance(spark, m).collect()}
    assert sum(got.values()) == pytest.approx(1)
    assert [got[f] for f in scoring.MODEL_FEATURES] == pytest.approx([v / sum(total) for v in total], abs=1e-9)


def test_curve_ends_at_the_evaluation(spark, fitted):
    rows, m = fitted
    held = rows.where("is_test")
    curve = model.evaluation_curve(m, held).orderBy("round").collect()
    assert [r["round"] for r in curve] == list(range(1, 13))
    metrics = regression_metrics(model.predict(m, held), model.LABEL, "predicted_delivery_minutes").first()
    assert curve[-1]["rmse"] == pytest.approx(metrics["rmse"], abs=1e-9)
    train = model.evaluation_curve(m, rows.where(~F.col("is_test"))).orderBy("round").collect()
    assert train[-1]["mse"] < train[0]["mse"]  # on its own rows boosting only gains


def test_validation_column_stops_boosting(spark, fitted):
    rows, _ = fitted
    stopped = model.fit(rows, validation="is_test", maxIter=60, maxDepth=3, validationTol=0.01)
    assert 1 <= stopped.stages[-1].getNumTrees < 60


def test_trained_model_scores_batches(spark, fitted):
    _, m = fitted
    t = commerce.tables(spark, "/root/testdata/sf0.001")
    predictions, rejects = scoring.score_batch(t, model.scorer(m, "gbt-1"), limit=50)
    got = predictions.collect()
    assert len(got) == 50 and rejects.isEmpty() and {r["model_version"] for r in got} == {"gbt-1"}
    features = scoring.inference_features(scoring.confirmed_orders(t, 50), history.delivered(t.orders))
    want = {r["order_id"]: r["predicted_delivery_minutes"] for r in model.predict(m, features).collect()}
    assert {r["order_id"]: r["predicted_delivery_minutes"] for r in got} == pytest.approx(want)
