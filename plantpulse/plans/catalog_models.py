"""Queries over training, scoring, monitoring and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse import session
from plantpulse.operators import alerts, energy, learning, monitoring, windows
from plantpulse.operators.scorer import WeightedScorer
from plantpulse.plans import fixtures as fx
from plantpulse.plans.catalog_tables import CONTRACT_SQL, SCORER, SCORER_SQL, STATS_SQL, scorer_sql
from plantpulse.plans.catalog_series import EMITTED_SQL, base
from plantpulse.plans.registry import (
    ALERTS_SQL, LOG_SQL, NEW_SQL, OLD_SQL, RUNS_SQL, query, r, rounded, sql,
)
from plantpulse.schema import SENSORS
from plantpulse.sources import log, tables
from plantpulse.streaming import jobs

# what the scores mean is fixed by SQL: advice looks at the readings with gaps as zero
SEVERITY_SQL = "case when p > 0.7 then 'high' when p > 0.3 then 'medium' else 'low' end as severity"
ADVICE_SQL = """concat_ws(' | ',
  case when prediction = 1 then 'Immediate maintenance recommended' end,
  case when prediction = 1 and Power > 3.0 then 'High power consumption detected - check compressor' end,
  case when prediction = 1 and abs(T_Supply - T_Return) > 5 then 'Large temperature differential - inspect heat exchange' end,
  case when prediction = 0 then 'Equipment operating normally' end,
  case when prediction = 0 and p > 0.3 then 'Monitor closely - approaching threshold' end) as recommendations"""

# Fixed value: size of the forest of the batch job.
TREES = 50
LABELLED_SQL = """labelled as (select *, cast(failure_window > 0 as int) as failure_imminent from (
  select *, sum(is_failure) over (partition by unit_id order by ts, reading_id
    rows between 23 preceding and current row) as failure_window
  from (select *, cast(coalesce(Power <= 0, false) as int) as is_failure from sensor_readings)))"""


def labelled(spark, sf):
    return windows.create_failure_labels(base(spark, sf, *SENSORS))


def training(spark, sf):
    """Labelled readings with gaps as zero, split in time order, staged once for many passes."""
    df = windows.impute_zero(labelled(spark, sf), SENSORS)
    return session.staged(learning.time_split(df, SENSORS))


# --- J: training sets -----------------------------------------------------------

@query("time_split", sql(f"""select reading_id, failure_imminent,
  case when i < floor(n * (1 - 0.2)) then 'train' else 'test' end as split
  from (select *, row_number() over (order by ts, reading_id) - 1 as i, count(*) over () as n from labelled
        where {' and '.join(f'{c} is not null' for c in SENSORS)})""", LABELLED_SQL))
def time_split(spark, sf):
    return learning.time_split(labelled(spark, sf), SENSORS).select("reading_id", "failure_imminent", "split")


@query("undersample", sql("""select reading_id, is_failure from (select *,
  row_number() over (partition by is_failure order by md5(reading_id::varchar), reading_id) as rn from labelled)
  where rn <= (select min(n) from (select count(*) as n from labelled group by is_failure))""", LABELLED_SQL))
def undersample(spark, sf):
    df = labelled(spark, sf).select("reading_id", "is_failure")
    return learning.undersample(df, "is_failure", "reading_id")


@query("class_weights", sql(f"""select is_failure, n, {r('total / (2 * n)', 'balanced_weight')},
  {r('neg / greatest(pos, 1)', 'scale_pos_weight')} from (select is_failure, count(*)::double as n_, count(*) as n,
  (select count(*) from labelled)::double as total, (select count(*) from labelled where is_failure = 1)::double as pos,
  (select count(*) from labelled where is_failure = 0)::double as neg from labelled group by 1)""", LABELLED_SQL))
def class_weights(spark, sf):
    return rounded(learning.class_weights(labelled(spark, sf), "is_failure"))


@query("rf_classifier")
def rf_classifier(spark, sf):
    """Test scores of a balanced random forest on the time split."""
    df = training(spark, sf)
    model = learning.train_classifier(df.filter("split = 'train'"), SENSORS, "random_forest", trees=TREES)
    scored = learning.score(df.filter("split = 'test'"), model)
    return rounded(learning.classifier_metrics(scored, "failure_imminent"))


@query("gbt_classifier")
def gbt_classifier(spark, sf):
    """Test scores of boosted trees with the positive class scaled."""
    df = training(spark, sf)
    model = learning.train_classifier(df.filter("split = 'train'"), SENSORS, "xgboost")
    scored = learning.score(df.filter("split = 'test'"), model)
    return rounded(learning.classifier_metrics(scored, "failure_imminent"))


def _metrics_sql() -> str:
    cells = {(a, b): f"(count(*) filter (actual = {a} and prediction = {b}))::double" for a in (0, 1) for b in (0, 1)}
    c = {k: f"c{k[0]}{k[1]}" for k in cells}
    n = "(c00 + c01 + c10 + c11)"
    out = {"accuracy": f"(c00 + c11) / {n}"} | {f"confusion_{a}_{b}": c[a, b] for a in (0, 1) for b in (0, 1)}
    per = {}
    for k in (0, 1):
        o = 1 - k
        p = f"coalesce({c[k, k]} / nullif({c[k, k]} + {c[o, k]}, 0), 0)"
        rec = f"coalesce({c[k, k]} / nullif({c[k, 0]} + {c[k, 1]}, 0), 0)"
        per[k] = {"precision": p, "recall": rec, "f1": f"coalesce(2 * {p} * {rec} / nullif({p} + {rec}, 0), 0)"}
        out |= {f"{m}_{k}": e for m, e in per[k].items()} | {f"support_{k}": f"{c[k, 0]} + {c[k, 1]}"}
    for m in ("precision", "recall", "f1"):
        out[f"{m}_macro"] = f"({per[0][m]} + {per[1][m]}) / 2"
        out[f"{m}_weighted"] = f"({per[0][m]} * (c00 + c01) + {per[1][m]} * (c10 + c11)) / {n}"
    rows = "\nunion all\n".join(f"select '{m}' as metric, {r(e, 'value')} from counts" for m, e in out.items())
    auc = """select 'roc_auc', """ + r("sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))", "value") + """ from (
      select *, coalesce(sum(neg) over (order by probability rows between unbounded preceding and 1 preceding), 0) as below
      from (select probability, (count(*) filter (actual = 1))::double as pos,
            (count(*) filter (actual = 0))::double as neg
            from known group by 1))"""
    counts = "counts as (select " + ", ".join(f"{e} as {c[k]}" for k, e in cells.items()) + " from known)"
    known = "known as (select * from prediction_log where actual is not null)"
    return sql(rows + "\nunion all\n" + auc, LOG_SQL, known, counts)


@query("classifier_metrics", _metrics_sql())
def classifier_metrics(spark, sf):
    log = fx.prediction_log(spark, sf).filter("actual is not null")
    return rounded(learning.classifier_metrics(log, "actual"))


@query("ts_folds", sql("""select reading_id, cast(greatest(0, floor((i - (n - 5 * b)) / b) + 1) as int) as fold
  from (select reading_id, row_number() over (order by ts, reading_id) - 1 as i, count(*) over () as n,
        count(*) over () // 6 as b from sensor_readings)"""))
def ts_folds(spark, sf):
    return learning.fold_ids(base(spark, sf)).select("reading_id", "fold")


@query("ts_cross_validate")
def ts_cross_validate(spark, sf):
    """Accuracy of a forest on five expanding folds."""
    df = session.staged(windows.impute_zero(labelled(spark, sf), SENSORS))
    return rounded(learning.ts_cross_validate(df, SENSORS, lambda: learning.random_forest(trees=TREES)))


@query("train_ensemble")
def train_ensemble(spark, sf):
    """Test AUC of each of the three models of the ensemble."""
    df = training(spark, sf)
    models = learning.train_ensemble(df.filter("split = 'train'"), SENSORS, {
        "rf": learning.random_forest, "xgb": learning.boosted_trees, "lgb": learning.leafwise_trees})
    out, test = None, df.filter("split = 'test'")
    for name, model in models.items():
        scored = learning.score(test, model)
        row = learning.roc_auc(scored, "failure_imminent").select(F.lit(name).alias("model"), "roc_auc")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


SECOND = WeightedScorer({"T_Supply": 0.05, "RH_Return": -0.03, "Power": -0.5}, 0.4)
SECOND_SQL = scorer_sql(SECOND, "second")


@query("ensemble_predict", sql(f"""select reading_id, {r('(a.p + b.p) / 2', 'probability')},
  cast((a.p + b.p) / 2 > 0.5 as int) as prediction from scored a join second b using (reading_id)""", SCORER_SQL, SECOND_SQL))
def ensemble_predict(spark, sf):
    df = windows.impute_zero(base(spark, sf, *SENSORS), SENSORS)
    out = learning.ensemble_predict(df, {"first": SCORER, "second": SECOND})
    return rounded(out.select("reading_id", "probability", "prediction"))


@query("batch_score", sql(f"""select reading_id, ts, prediction, {r('p', 'probability')},
  case when prediction = 1 then 'Failure' else 'Normal' end as label, {SEVERITY_SQL}, {ADVICE_SQL} from scored""", SCORER_SQL))
def batch_score(spark, sf):
    out = learning.batch_score(base(spark, sf, *SENSORS), SCORER, SENSORS)
    return rounded(out.select("reading_id", "ts", "prediction", "probability", "label", "severity",
                              F.concat_ws(" | ", "recommendations").alias("recommendations")))


@query("linear_baseline", sql(f"""select {r('regr_slope(Power, T_Outdoor)', 'slope', 8)},
  {r('regr_intercept(Power, T_Outdoor)', 'intercept', 8)}, {r('var_pop(Power) * (1 - regr_r2(Power, T_Outdoor))', 'mse')},
  {r('sqrt(var_pop(Power) * (1 - regr_r2(Power, T_Outdoor)))', 'rmse')}, {r('regr_r2(Power, T_Outdoor)', 'r2_score', 9)},
  count(*) as rows from sensor_readings where T_Outdoor is not null and Power is not null"""))
def linear_baseline(spark, sf):
    out = energy.simple_regression(fx.sensor_readings(spark, sf), "T_Outdoor", "Power")
    return rounded(out, slope=8, intercept=8, r2_score=9)


# normal equations of three centred inputs, solved by determinants
SOLVED_SQL = """moments as (select avg(T_Supply) as ma, avg(T_Outdoor) as mb, avg(RH_Return) as mc, avg(Power) as my,
  var_pop(T_Supply) as aa, var_pop(T_Outdoor) as bb, var_pop(RH_Return) as cc, covar_pop(T_Supply, T_Outdoor) as ab,
  covar_pop(T_Supply, RH_Return) as ac, covar_pop(T_Outdoor, RH_Return) as bc, covar_pop(T_Supply, Power) as ay,
  covar_pop(T_Outdoor, Power) as by_, covar_pop(RH_Return, Power) as cy
  from sensor_readings where T_Supply is not null and T_Outdoor is not null and RH_Return is not null and Power is not null),
solved as (select ma, mb, mc, my,
  (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det as ka,
  (aa * (by_ * cc - cy * bc) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det as kb,
  (aa * (bb * cy - bc * by_) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det as kc
  from (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from moments))"""
PREDICTED = ("my + ka * (coalesce(T_Supply, 0) - ma) + kb * (coalesce(T_Outdoor, 0) - mb) "
             "+ kc * (coalesce(RH_Return, 0) - mc)")


@query("demand_predict", sql(f"select reading_id, {r(PREDICTED, 'predicted_power')} from sensor_readings, solved", SOLVED_SQL))
def demand_predict(spark, sf):
    """Predicted power of every reading from a fit on several sensors."""
    df, inputs = base(spark, sf, *SENSORS), ["T_Supply", "T_Outdoor", "RH_Return"]
    model, _ = learning.linear_baseline(df, inputs)
    return rounded(learning.demand_predict(model, df, inputs).select("reading_id", "predicted_power"))


RESIDUAL_SQL = """residuals as (select Power, Power - (my + ka * (T_Supply - ma) + kb * (T_Outdoor - mb) + kc * (RH_Return - mc)) as gap
  from sensor_readings, solved
  where T_Supply is not null and T_Outdoor is not null and RH_Return is not null and Power is not null)"""


@query("linear_baseline_several", sql(f"""select {r('avg(gap * gap)', 'mse')}, {r('sqrt(avg(gap * gap))', 'rmse')},
  {r('1 - avg(gap * gap) / var_pop(Power)', 'r2_score', 9)} from residuals""", SOLVED_SQL, RESIDUAL_SQL))
def linear_baseline_several(spark, sf):
    """Quality of a fit on several sensors, on the complete rows."""
    _, metrics = learning.linear_baseline(fx.sensor_readings(spark, sf), ["T_Supply", "T_Outdoor", "RH_Return"])
    return rounded(metrics, r2_score=9)


@query("setpoint_recommend", sql(f"""select {r('slope', 'slope', 9)}, {r('intercept', 'intercept')}, i::int as i,
  {r('lo + i * (hi - lo) / 9', 'outdoor')}, printf('outdoor_%.1fC', lo + i * (hi - lo) / 9) as label,
  {r('intercept + slope * (lo + i * (hi - lo) / 9)', 'setpoint')}
  from (select regr_slope(SP_Return, T_Outdoor) as slope, regr_intercept(SP_Return, T_Outdoor) as intercept,
        min(T_Outdoor) as lo, max(T_Outdoor) as hi from sensor_readings), (select unnest(range(10)) as i)"""))
def setpoint_recommend(spark, sf):
    return rounded(energy.recommend_setpoints(fx.sensor_readings(spark, sf)), slope=9)


@query("training_history")
def training_history(spark, sf):
    """One row per trained model, appended to a history table and read back."""
    path = session.new_folder(spark, "history")
    history = learning.timed_training(
        training(spark, sf), SENSORS, {"random_forest": {"trees": TREES}, "lightgbm": {}})
    tables.append_log(history, path, ts="trained_at")
    return rounded(tables.read_log(spark, path).select("model_name", "model_type", "accuracy", "roc_auc", "features"))


# --- M: monitoring --------------------------------------------------------------

@query("prediction_log", sql(f"""select reading_id, {r('T_Supply', 'supply')}, prediction,
  {r('probability', 'probability')}, actual from prediction_log""", LOG_SQL))
def prediction_log(spark, sf):
    path = session.new_folder(spark, "predictions")
    log = fx.prediction_log(spark, sf)
    rows = tables.prediction_records(log, ["reading_id", "T_Supply", "Power"], actual="actual")
    for hour in (0, 1):
        for _ in range(2):  # a job that runs again adds nothing
            tables.append_log(rows.filter(F.hour("ts") % 2 == hour), path, writer="scorer", batch=hour)
    return rounded(tables.read_log(spark, path).select(
        F.col("features")["reading_id"].cast("long").alias("reading_id"),
        F.col("features")["T_Supply"].alias("supply"), "prediction", "probability", "actual"))


Z = "abs(new_mean - reference_mean) / reference_std"


@query("drift_score", sql(f"select {r(f'avg({Z})', 'drift_score')} from ({STATS_SQL}) where reference_std > 0",
                          OLD_SQL, NEW_SQL))
def drift_score(spark, sf):
    old, new = fx.split_windows(fx.sensor_readings(spark, sf))
    return rounded(monitoring.drift_score(old, new, SENSORS))


RIGHT = "avg(case when prediction = actual then 1e0 else 0e0 end)"


@query("degradation_check", sql(f"""select case when {RIGHT} is null then 'unknown' when {RIGHT} < 0.8 then 'degraded'
  else 'healthy' end as status, {r(RIGHT, 'accuracy')}, 0.8e0 as threshold,
  printf('Model accuracy: %.2f%%', {RIGHT} * 100) as message from prediction_log where actual is not null""", LOG_SQL))
def degradation_check(spark, sf):
    return rounded(monitoring.degradation_check(fx.prediction_log(spark, sf)))


@query("performance_report", sql(f"""select case when n = 0 then 'no_data' when labeled = 0 then 'waiting_for_labels'
  when accuracy > 0.8 then 'healthy' else 'degraded' end as status, n as total_predictions,
  labeled as labeled_predictions, {r('accuracy', 'accuracy')},
  {r(f'(select avg({Z}) from ({STATS_SQL}) where reference_std > 0)', 'drift_score')}
  from (select count(*) as n, count(actual) as labeled,
        avg(case when actual is null then null when prediction = actual then 1e0 else 0e0 end) as accuracy
        from prediction_log)""", LOG_SQL, OLD_SQL, NEW_SQL))
def performance_report(spark, sf):
    old, new = fx.split_windows(fx.sensor_readings(spark, sf))
    drift = monitoring.drift_score(old, new, SENSORS)
    return rounded(monitoring.performance_report(fx.prediction_log(spark, sf), drift=drift))


@query("drift_fit", sql("\nunion all\n".join(
    f"select '{c}' as feature, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')}, "
    f"{r(f'max({c})', 'max')} from reference_window" for c in SENSORS), OLD_SQL))
def drift_fit(spark, sf):
    old, _ = fx.split_windows(fx.sensor_readings(spark, sf))
    return rounded(monitoring.drift_fit(old, SENSORS))


DRIFT_SQL = sql(f"""select feature, {r(Z, 'z_score')}, {Z} > 1 as drifted, {r('reference_mean', 'reference_mean')},
  {r('new_mean', 'new_mean')}, count(*) filter ({Z} > 1) over () as drifted_features, count(*) over () as total_features
  from ({STATS_SQL}) where reference_std > 0""", OLD_SQL, NEW_SQL)


@query("drift_detect", DRIFT_SQL)
def drift_detect(spark, sf):
    old, new = fx.split_windows(fx.sensor_readings(spark, sf))
    return rounded(monitoring.drift_detect(monitoring.drift_fit(old, SENSORS), new, SENSORS, threshold=1.0))


@query("alert_log", sql("""select row_number() over (order by ts, alert_id) as id, alert_id, type, ts, severity, k,
  false as acknowledged from kept""", ALERTS_SQL, EMITTED_SQL, recursive=True))
def alert_log(spark, sf):
    out = alerts.alert_log(fx.alerts(spark, sf))
    return out.select("id", "alert_id", "type", "ts", "severity", F.col("metadata")["k"].alias("k"), "acknowledged")


@query("alert_ack", sql("""select alert_id, type, case when alert_id % 4 = 0 then ts end as acknowledged_at,
  alert_id % 4 = 0 as acknowledged from alerts""", ALERTS_SQL))
def alert_ack(spark, sf):
    return alerts.acknowledge(fx.alerts(spark, sf), fx.alert_acks(spark, sf)).select(
        "alert_id", "type", "acknowledged_at", "acknowledged")


@query("alert_summary", sql("""select severity, count(*) as count, (select count(*) from alerts) as total_alerts,
  (select count(*) from alerts where alert_id % 4 <> 0) as active,
  (select count(*) from alerts where alert_id % 4 = 0) as acknowledged from alerts group by 1""", ALERTS_SQL))
def alert_summary(spark, sf):
    return alerts.alert_summary(alerts.acknowledge(fx.alerts(spark, sf), fx.alert_acks(spark, sf)))


@query("pipeline_log", sql(f"""select pipeline, status, count(*) as runs, {r('sum(duration_seconds)', 'seconds', 3)}
  from pipeline_runs group by 1, 2""", RUNS_SQL))
def pipeline_log(spark, sf):
    path = session.new_folder(spark, "runs")
    runs = tables.run_records(fx.pipeline_runs(spark, sf), ["duration_seconds"])
    for name in ("training", "inference", "training"):
        tables.append_log(runs.filter(F.col("pipeline") == name), path, writer=name, batch="2024")
    log.compact(spark, path)
    back = tables.read_log(spark, path).groupBy("pipeline", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.col("metrics")["duration_seconds"]).alias("seconds"))
    return rounded(back, 3)


@query("monitoring_report", sql(f"""select 'model' as part, case when {RIGHT.replace('when prediction', 'when actual is null then null when prediction')} > 0.8
  then 'healthy' else 'degraded' end as status, count(*) as n from prediction_log
  union all select 'alerts', 'active', count(*) from alerts where alert_id % 4 <> 0
  union all select 'alerts', severity, count(*) from alerts group by severity
  union all select pipeline, case when avg(case when status = 'success' then 1e0 else 0e0 end) > 0.9 then 'healthy'
  else 'degraded' end, count(*) from (select *, row_number() over (partition by pipeline order by ts desc, event_id desc)
  as rn from pipeline_runs) where rn <= 10 group by pipeline""", LOG_SQL, ALERTS_SQL, RUNS_SQL))
def monitoring_report(spark, sf):
    out = monitoring.monitoring_report(
        fx.prediction_log(spark, sf), alerts.acknowledge(fx.alerts(spark, sf), fx.alert_acks(spark, sf)),
        fx.pipeline_runs(spark, sf), order=("ts", "event_id"))
    model = out.select(F.lit("model").alias("part"), "model_performance.status",
                       F.col("model_performance.total_predictions").alias("n"))
    active = out.select(F.lit("alerts"), F.lit("active"), "alerts.active")
    severity = out.select(F.lit("alerts"), F.explode("alerts.by_severity"))
    health = out.select(F.explode("pipelines").alias("part", "h")).select("part", "h.status", "h.recent_runs")
    return model.union(active).union(severity).union(health)


# --- K: streams -----------------------------------------------------------------

def event_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return jobs.read_stream(spark, sf, schema, pattern="events.parquet")


def _folders(spark, name):
    root = session.new_folder(spark, name)
    return f"{root}/out", f"{root}/checkpoint"


@query("stream_contract", CONTRACT_SQL)
def stream_contract(spark, sf):
    checked = jobs.stream_contract(fx.readings_of(event_stream(spark, sf)))
    out = jobs.run_available(checked, *_folders(spark, "stream_contract"))
    return out.select("reading_id", F.concat_ws(", ", "reasons").alias("reasons"), "is_valid")


@query("stream_score", sql(f"""select reading_id, prediction, {r('p', 'probability')}, {SEVERITY_SQL}, {ADVICE_SQL}
  from scored""", SCORER_SQL))
def stream_score(spark, sf):
    scored = jobs.stream_score(fx.readings_of(event_stream(spark, sf)), SCORER, SENSORS)
    out = jobs.run_available(scored, *_folders(spark, "stream_score"))
    return rounded(out.select("reading_id", "prediction", "probability", "severity",
                              F.concat_ws(" | ", "recommendations").alias("recommendations")))


@query("stream_alert_cooldown", sql("select alert_id, type, epoch_us(ts) as at from kept", ALERTS_SQL, EMITTED_SQL,
                                    recursive=True))
def stream_alert_cooldown(spark, sf):
    kept = jobs.stream_alert_cooldown(fx.alerts_of(event_stream(spark, sf)))
    versions = jobs.run_versions(kept, *_folders(spark, "stream_cooldown"))
    return jobs.emitted_alerts(versions).select("alert_id", "type", "at")


@query("stream_profile", sql(f"""select date_trunc('hour', ts) as start, count(*) as rows, {r('avg(Power)', 'mean_power', 9)},
  {r('sum(Power)', 'power_sum', 4)}, {r('max(Power)', 'peak_power')}, cast(count(*) filter (Power > 0) as bigint) as on_rows
  from sensor_readings group by 1"""))
def stream_profile(spark, sf):
    profiled = jobs.stream_profile(fx.readings_of(event_stream(spark, sf)))
    out = jobs.latest(jobs.run_versions(profiled, *_folders(spark, "stream_profile")), ["start"])
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), mean_power=9, power_sum=4)


@query("stream_drift", DRIFT_SQL)
def stream_drift(spark, sf):
    old, _ = fx.split_windows(fx.sensor_readings(spark, sf))
    reference = session.staged(monitoring.drift_fit(old, SENSORS), "drift_reference")
    _, new = fx.split_windows(fx.readings_of(event_stream(spark, sf)))
    out = jobs.stream_drift(new, reference, SENSORS, *_folders(spark, "stream_drift"), threshold=1.0)
    return rounded(out.drop("batch"))


@query("stream_window_drift", sql(f"""select start, feature, {r(Z, 'z_score')}, {Z} > 1 as drifted,
  {r('reference_mean', 'reference_mean')}, {r('new_mean', 'new_mean')},
  count(*) filter ({Z} > 1) over (partition by start) as drifted_features, count(*) over (partition by start) as total_features
  from (select * from (""" + "\nunion all\n".join(
      f"select '{c}' as feature, avg({c}) as reference_mean, stddev_samp({c}) as reference_std from reference_window"
      for c in SENSORS) + """) o join (""" + "\nunion all\n".join(
      f"select date_trunc('day', ts) - interval (12 * h) hour as start, '{c}' as feature, avg({c}) as new_mean "
      f"from (select *, 1 - 2 * (ts - date_trunc('day', ts) >= interval 12 hour)::int as h from new_window union all "
      f"select *, 0 from new_window) group by 1" for c in SENSORS) + """) n using (feature)) where reference_std > 0""",
    OLD_SQL, NEW_SQL))
def stream_window_drift(spark, sf):
    """Drift of every day, a new one each twelve hours, from moments in the stream's state."""
    old, _ = fx.split_windows(fx.sensor_readings(spark, sf))
    reference = session.staged(monitoring.drift_fit(old, SENSORS), "drift_reference")
    _, new = fx.split_windows(fx.readings_of(event_stream(spark, sf)))
    moments = jobs.stream_moments(new, SENSORS, "1 day", "12 hours")
    state = jobs.latest(jobs.run_versions(moments, *_folders(spark, "window_drift")), ["start", "end"])
    out = jobs.window_drift(state, reference, SENSORS, threshold=1.0)
    return rounded(out.drop("end").withColumn("start", F.col("start").cast("timestamp_ntz")))
