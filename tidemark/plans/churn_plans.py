"""Registered churn queries on the transparent score, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.bands import risk_level, tenure_band
from tidemark.operators import evaluation, insights, scoring, segments
from tidemark.plans.common import CHURN, CHURN_SEGMENTS, r, rounded, with_ctes
from tidemark.sources import files
from tidemark.sources.tables import customers
from tidemark.staging import new_path


def _scored(spark, d):
    return scoring.with_scores(customers(spark, d), scoring.churn_score(), "Churn")


def _segmented(spark, d, *only):
    """Scores with the named segments (all by default); the rank of the charge is staged, so only needed columns go in."""
    scored = _scored(spark, d)
    if only:
        scored = scored.select("customerID", "tenure", "Contract", "PaymentMethod", "MonthlyCharges", "Churn_Probability", "Risk_Level")
    return segments.with_segments(scored, only=list(only) or None)


def churn_logit_score(spark, d):
    c = customers(spark, d)
    return rounded(c.select("customerID", scoring.churn_score().alias("probability")), 8)


def scored_by_formula(spark, d):
    """All customers with score columns in output order: id and target, scores, the rest."""
    return rounded(_scored(spark, d))


def risk_level_cut(spark, d):
    return _scored(spark, d).select("customerID", risk_level("Churn_Probability").alias("risk_level"))


def tenure_segment_cut(spark, d):
    return customers(spark, d).select("customerID", tenure_band("tenure").alias("tenure_segment"))


def contract_segment(spark, d):
    """The contract name, and the segment of a table that has a renewal flag only."""
    c = customers(spark, d)
    flag = F.when(F.pmod("customerID", F.lit(3)) == 0, 1).otherwise(0)
    renewal = segments.contract_segment(spark.createDataFrame([], "customerID long, ContractRenewal int"))
    flagged = c.select("customerID", segments.contract_segment(c).alias("contract_segment"), flag.alias("ContractRenewal"))
    return flagged.select("customerID", "contract_segment", renewal.alias("renewal_segment"))


def payment_segment(spark, d):
    """Without a payment column the overage fee is cut into three equal-count bands."""
    fees = customers(spark, d).select("customerID", F.col("TotalCharges").alias("OverageFee"), F.col("PaymentMethod").alias("way"))
    bands = segments.with_segments(fees, only=["Payment_Segment"])
    return bands.select("customerID", F.col("way").alias("payment_segment"), F.col("Payment_Segment").alias("overage_segment"))


def charge_quartile(spark, d):
    return _segmented(spark, d, "Charge_Segment").select("customerID", "MonthlyCharges", "Charge_Segment")


def enrich_segments(spark, d):
    return _segmented(spark, d, *segments.SEGMENTS).select("customerID", *segments.SEGMENTS)


def risk_queue(spark, d):
    """High and medium risk customers from 40 percent on."""
    queue = scoring.risk_queue(_scored(spark, d), C.RISK_LEVELS[1:], 0.4)
    return rounded(queue.select(*scoring.display_columns(queue, "Churn")), 6)


def risk_queue_top(spark, d):
    queue = scoring.risk_queue(_scored(spark, d)).limit(12)
    return rounded(queue.select("customerID", "Churn_Probability", "Risk_Level"), 6)


def risk_distribution(spark, d):
    return scoring.risk_distribution(_scored(spark, d))


def churn_kpis(spark, d):
    return rounded(scoring.churn_kpis(_scored(spark, d)))


def revenue_at_risk(spark, d):
    return rounded(scoring.revenue_at_risk(_scored(spark, d)))


def _risk_by(segment: str):
    def run(spark, d):
        return rounded(segments.mean_risk(_segmented(spark, d, segment), segment))

    return run, with_ctes(
        f"SELECT segment, {r('m')} AS mean_probability, {r('m / SUM(m) OVER ()')} AS share FROM (SELECT {segment} AS segment, AVG(Churn_Probability) AS m FROM seg GROUP BY 1)",
        **CHURN_SEGMENTS,
    )


def contract_risk_mix(spark, d):
    return segments.contract_risk_mix(_segmented(spark, d, "Contract_Segment"))


def tenure_charge_pivot(spark, d):
    return rounded(segments.tenure_charge_pivot(_segmented(spark, d, "Tenure_Segment", "Charge_Segment")))


def charge_quartiles_by_risk(spark, d):
    return rounded(segments.charge_quartiles(_scored(spark, d)))


def business_insights(spark, d):
    return insights.business_insights(_segmented(spark, d, "Tenure_Segment", "Contract_Segment", "Payment_Segment"))


def exec_summary(spark, d):
    return insights.executive_summary(_scored(spark, d))


def confusion(spark, d):
    return evaluation.confusion(_scored(spark, d), "Churn", "Predicted_Churn")


def classification_metrics(spark, d):
    return rounded(evaluation.classification_metrics(_scored(spark, d), "Churn", "Predicted_Churn"))


def report(spark, d):
    return rounded(evaluation.report(_scored(spark, d), "Churn", "Predicted_Churn"))


def class_balance(spark, d):
    return evaluation.class_balance(customers(spark, d), "Churn")


def predictions_csv(spark, d):
    """The filtered predictions written as CSV, one folder per risk band, and read back."""
    queue = scoring.risk_queue(_scored(spark, d), C.RISK_LEVELS[1:])
    path = new_path(spark, "predictions-csv")
    files.write_csv(queue.select(*scoring.display_columns(queue, "Churn")), path, partition_by=["Risk_Level"])
    back = files.read_csv_text(spark, path)
    return rounded(
        back.select(
            F.col("customerID").cast("bigint").alias("customerID"), F.col("Churn").cast("int").alias("Churn"),
            F.col("Churn_Probability").cast("double").alias("Churn_Probability"),
            F.col("Predicted_Churn").cast("int").alias("Predicted_Churn"), "Risk_Level",
        ),
        6,
    )


def _short_score(spark, d):
    """Scores rounded to eight decimals, so that equal scores are equal in any engine."""
    return _scored(spark, d).withColumn("Churn_Probability", F.round("Churn_Probability", 8))


def roc_points(spark, d):
    return evaluation.roc_points(_short_score(spark, d), "Churn", "Churn_Probability")


def roc_turns(spark, d):
    """The ROC curve of a coarse score without the points on a line."""
    scored = _short_score(spark, d).withColumn("Churn_Probability", F.round("Churn_Probability", 2))
    return evaluation.roc_points(scored, "Churn", "Churn_Probability", drop_collinear=True)


def roc_auc(spark, d):
    return rounded(evaluation.roc_auc(_short_score(spark, d), "Churn", "Churn_Probability"), 8)


_CELLS = {
    **CHURN,
    "k": """SELECT CAST(COUNT(*) FILTER (Churn = 0 AND Predicted_Churn = 0) AS DOUBLE) AS tn, CAST(COUNT(*) FILTER (Churn = 0 AND Predicted_Churn = 1) AS DOUBLE) AS fp,
      CAST(COUNT(*) FILTER (Churn = 1 AND Predicted_Churn = 0) AS DOUBLE) AS fn, CAST(COUNT(*) FILTER (Churn = 1 AND Predicted_Churn = 1) AS DOUBLE) AS tp FROM scored""",
}


def _prf(hit: str, wrongly: str, missed: str) -> list[str]:
    return [
        f"COALESCE({hit} / NULLIF({hit} + {wrongly}, 0), 0)",
        f"COALESCE({hit} / NULLIF({hit} + {missed}, 0), 0)",
        f"COALESCE(2 * {hit} / NULLIF(2 * {hit} + {wrongly} + {missed}, 0), 0)",
    ]


_ONE, _ZERO = _prf("tp", "fp", "fn"), _prf("tn", "fn", "fp")
_ALL = "(tn + fp + fn + tp)"
_FIELDS = ["precision", "recall", "f1_score"]


def _line(name: str, values: list[str], support: str) -> str:
    cells = ", ".join(f"{r(v)} AS {f}" for v, f in zip(values, _FIELDS))
    return f"SELECT '{name}' AS class, {cells}, {r(support)} AS support FROM k"


_REPORT = " UNION ALL ".join(
    [
        _line("0", _ZERO, "tn + fp"),
        _line("1", _ONE, "tp + fn"),
        _line("accuracy", [f"(tp + tn) / {_ALL}"] * 3, f"(tp + tn) / {_ALL}"),
        _line("macro avg", [f"({a} + {b}) / 2" for a, b in zip(_ZERO, _ONE)], _ALL),
        _line("weighted avg", [f"({a} * (tn + fp) + {b} * (tp + fn)) / {_ALL}" for a, b in zip(_ZERO, _ONE)], _ALL),
    ]
)
_ROC = {
    **CHURN,
    "g": "SELECT ROUND(Churn_Probability, 8) AS score, COUNT(*) FILTER (Churn = 1) AS pos, COUNT(*) FILTER (Churn = 0) AS neg FROM scored GROUP BY 1",
    "c": """SELECT *, CAST(SUM(pos) OVER w AS BIGINT) AS tp, CAST(SUM(neg) OVER w AS BIGINT) AS fp, CAST(SUM(pos) OVER () AS BIGINT) AS p,
      CAST(SUM(neg) OVER () AS BIGINT) AS n FROM g WINDOW w AS (ORDER BY score DESC)""",
}


def _worst(segment: str) -> str:
    return f"(SELECT {{'s': {segment}, 'm': AVG(Churn_Probability)}} FROM seg GROUP BY {segment} ORDER BY ROUND(AVG(Churn_Probability), 12) DESC, {segment} LIMIT 1)"


def _fill(text: str, **parts: str) -> str:
    body = "'" + text.replace("'", "''") + "'"
    for key, value in parts.items():
        body = f"replace({body}, '{{{key}}}', {value})"
    return body


def _pct(x: str) -> str:
    return f"printf('%.1f', ({x}) * 100) || '%'"


def _row(i: int, text: tuple[str, str], source: str, **parts: str) -> str:
    return f"SELECT CAST({i} AS INTEGER) AS ord, '{text[0]}' AS title, {_fill(text[1], **parts)} AS body FROM {source}"


QUERIES = {
    "churn_logit_score": (
        churn_logit_score,
        with_ctes(f"SELECT customerID, {r('Churn_Probability', 8)} AS probability FROM scored", **CHURN),
    ),
    "scored_by_formula": (
        scored_by_formula,
        with_ctes(
            f"""SELECT customerID, Churn, {r('Churn_Probability')} AS Churn_Probability, Predicted_Churn, Risk_Level, tenure, Contract,
            PaymentMethod, {r('MonthlyCharges')} AS MonthlyCharges, {r('TotalCharges')} AS TotalCharges, SupportTickets FROM scored""",
            **CHURN,
        ),
    ),
    "risk_level_cut": (risk_level_cut, with_ctes("SELECT customerID, Risk_Level AS risk_level FROM scored", **CHURN)),
    "tenure_segment_cut": (
        tenure_segment_cut,
        with_ctes("SELECT customerID, Tenure_Segment AS tenure_segment FROM seg", **CHURN_SEGMENTS),
    ),
    "contract_segment": (
        contract_segment,
        with_ctes(
            """SELECT customerID, COALESCE(Contract, 'nan') AS contract_segment,
            CASE WHEN customerID % 3 = 0 THEN 'Renewed Contract' ELSE 'No Renewal' END AS renewal_segment FROM customers""",
            **CHURN,
        ),
    ),
    "payment_segment": (
        payment_segment,
        with_ctes(
            """SELECT customerID, PaymentMethod AS payment_segment, CASE WHEN TotalCharges IS NULL THEN 'nan' WHEN (rk - 1) * 3 <= n - 1 THEN 'Low overage'
            WHEN (rk - 1) * 3 <= 2 * (n - 1) THEN 'Moderate overage' ELSE 'High overage' END AS overage_segment
            FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY TotalCharges NULLS LAST, customerID) AS rk, COUNT(TotalCharges) OVER () AS n FROM customers)""",
            **CHURN,
        ),
    ),
    "charge_quartile": (
        charge_quartile,
        with_ctes("SELECT customerID, MonthlyCharges, Charge_Segment FROM seg", **CHURN_SEGMENTS),
    ),
    "enrich_segments": (
        enrich_segments,
        with_ctes("SELECT customerID, Tenure_Segment, Charge_Segment, Contract_Segment, Payment_Segment FROM seg", **CHURN_SEGMENTS),
    ),
    "risk_queue": (
        risk_queue,
        with_ctes(
            f"""SELECT customerID, Churn, {r('Churn_Probability', 6)} AS Churn_Probability, Predicted_Churn, Risk_Level FROM scored
            WHERE Risk_Level IN ('Medium Risk', 'High Risk') AND scored.Churn_Probability >= 0.4""",
            **CHURN,
        ),
    ),
    "risk_queue_top": (
        risk_queue_top,
        with_ctes(
            f"""SELECT customerID, {r('p', 6)} AS Churn_Probability, Risk_Level FROM (SELECT customerID, Churn_Probability AS p, Risk_Level FROM scored)
            ORDER BY p DESC, customerID LIMIT 12""",
            **CHURN,
        ),
    ),
    "risk_distribution": (
        risk_distribution,
        with_ctes(
            """SELECT CAST(ord AS INTEGER) AS ord, v.Risk_Level, COUNT(s.Risk_Level) AS customers FROM
            (VALUES (0, 'Low Risk'), (1, 'Medium Risk'), (2, 'High Risk')) v(ord, Risk_Level)
            LEFT JOIN scored s ON s.Risk_Level = v.Risk_Level GROUP BY ALL""",
            **CHURN,
        ),
    ),
    "churn_kpis": (
        churn_kpis,
        with_ctes(
            f"""SELECT customers, {r('cr')} AS churn_rate, high_risk, {r('mp')} AS mean_probability,
            CASE WHEN cr > 0.28 THEN 'bad' WHEN cr > 0.16 THEN 'warn' ELSE 'good' END AS churn_status,
            CASE WHEN high_risk / greatest(customers, 1) > 0.25 THEN 'bad' ELSE 'warn' END AS risk_status
            FROM (SELECT COUNT(*) AS customers, AVG(Predicted_Churn) AS cr, COUNT(*) FILTER (Risk_Level = 'High Risk') AS high_risk,
              AVG(Churn_Probability) AS mp FROM scored)""",
            **CHURN,
        ),
    ),
    "revenue_at_risk": (
        revenue_at_risk,
        with_ctes(
            f"""SELECT {r("AVG(CAST(Risk_Level = 'High Risk' AS INTEGER))")} AS high_risk_rate,
            {r("COALESCE(CAST(SUM(CAST(MonthlyCharges AS DECIMAL(28,8))) FILTER (Risk_Level = 'High Risk') AS DOUBLE), 0)")} AS revenue_at_risk FROM scored""",
            **CHURN,
        ),
    ),
    "risk_by_tenure": _risk_by("Tenure_Segment"),
    "risk_by_payment": _risk_by("Payment_Segment"),
    "risk_by_contract": _risk_by("Contract_Segment"),
    "contract_risk_mix": (
        contract_risk_mix,
        with_ctes("SELECT Contract_Segment, Risk_Level, COUNT(*) AS customers FROM seg GROUP BY ALL", **CHURN_SEGMENTS),
    ),
    "tenure_charge_pivot": (
        tenure_charge_pivot,
        with_ctes(
            f"""SELECT t.Tenure_Segment, c.Charge_Segment, {r('COALESCE(m, 0)')} AS mean_probability
            FROM (SELECT DISTINCT Tenure_Segment FROM seg) t CROSS JOIN (SELECT DISTINCT Charge_Segment FROM seg) c
            LEFT JOIN (SELECT Tenure_Segment, Charge_Segment, AVG(Churn_Probability) AS m FROM seg GROUP BY ALL) x
            ON x.Tenure_Segment = t.Tenure_Segment AND x.Charge_Segment = c.Charge_Segment""",
            **CHURN_SEGMENTS,
        ),
    ),
    "charge_quartiles_by_risk": (
        charge_quartiles_by_risk,
        with_ctes(
            f"""SELECT Risk_Level, {r('MIN(MonthlyCharges)')} AS lowest, {r('quantile_cont(MonthlyCharges, 0.25)')} AS q25,
            {r('quantile_cont(MonthlyCharges, 0.5)')} AS q50, {r('quantile_cont(MonthlyCharges, 0.75)')} AS q75,
            {r('MAX(MonthlyCharges)')} AS highest FROM scored GROUP BY Risk_Level""",
            **CHURN,
        ),
    ),
    "business_insights": (
        business_insights,
        with_ctes(
            " UNION ALL ".join(
                [
                    _row(0, C.RETENTION_TEXTS["queue"], "w", rate=_pct("hr")),
                    _row(1, C.RETENTION_TEXTS["tenure"], "w", segment="t.s", rate=_pct("t.m")),
                    _row(2, C.RETENTION_TEXTS["contract"], "w", segment="c.s"),
                    _row(3, C.RETENTION_TEXTS["payment"], "w", segment="p.s"),
                ]
            ),
            **CHURN_SEGMENTS,
            w=f"""SELECT (SELECT AVG(CAST(Risk_Level = 'High Risk' AS INTEGER)) FROM seg) AS hr, {_worst('Tenure_Segment')} AS t,
              {_worst('Contract_Segment')} AS c, {_worst('Payment_Segment')} AS p""",
        ),
    ),
    "exec_summary": (
        exec_summary,
        with_ctes(
            " UNION ALL ".join(
                [
                    _row(0, C.SUMMARY_TEXTS["trend"], "x", rate=_pct("rate"), mean=_pct("mean")),
                    _row(1, C.SUMMARY_TEXTS["risk"], "x", high="format('{:,}', high)"),
                    _row(2, C.SUMMARY_TEXTS["advice"], "x"),
                    _row(3, C.SUMMARY_TEXTS["impact"], "x", revenue="'$' || format('{:,.0f}', revenue)"),
                ]
            ),
            **CHURN,
            x="""SELECT AVG(Predicted_Churn) AS rate, AVG(Churn_Probability) AS mean, COUNT(*) FILTER (Risk_Level = 'High Risk') AS high,
              COALESCE(CAST(SUM(CAST(MonthlyCharges AS DECIMAL(28,8))) FILTER (Risk_Level = 'High Risk') AS DOUBLE), 0) AS revenue FROM scored""",
        ),
    ),
    "class_balance": (
        class_balance,
        with_ctes(
            """SELECT COUNT(*) AS classes, MIN(n) AS smallest, COUNT(*) = 2 AND MIN(n) >= 2 AS stratify
            FROM (SELECT COUNT(*) AS n FROM customers GROUP BY Churn)""",
            **CHURN,
        ),
    ),
    "predictions_csv": (
        predictions_csv,
        with_ctes(
            f"""SELECT customerID, Churn, {r('Churn_Probability', 6)} AS Churn_Probability, Predicted_Churn, Risk_Level FROM scored
            WHERE Risk_Level IN ('Medium Risk', 'High Risk')""",
            **CHURN,
        ),
    ),
    "confusion": (
        confusion,
        with_ctes(
            """SELECT CAST(a AS INTEGER) AS actual, CAST(b AS INTEGER) AS predicted, COUNT(s.customerID) AS customers
            FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b) LEFT JOIN scored s ON s.Churn = a AND s.Predicted_Churn = b GROUP BY ALL""",
            **CHURN,
        ),
    ),
    "classification_metrics": (
        classification_metrics,
        with_ctes(
            f"SELECT {r(f'(tp + tn) / {_ALL}')} AS accuracy, {r(_ONE[0])} AS precision, {r(_ONE[1])} AS recall, {r(_ONE[2])} AS f1_score FROM k",
            **_CELLS,
        ),
    ),
    "report": (report, with_ctes(_REPORT, **_CELLS)),
    "roc_points": (
        roc_points,
        with_ctes("SELECT score AS threshold, fp, tp, fp / NULLIF(n, 0) AS fpr, tp / NULLIF(p, 0) AS tpr FROM c UNION ALL SELECT NULL, 0, 0, 0, 0", **_ROC),
    ),
    "roc_turns": (
        roc_turns,
        with_ctes(
            """SELECT score AS threshold, fp, tp, fp / NULLIF(n, 0) AS fpr, tp / NULLIF(p, 0) AS tpr
            FROM (SELECT *, LAG(score) OVER w AS above, LEAD(pos) OVER w AS pos_below, LEAD(neg) OVER w AS neg_below FROM c WINDOW w AS (ORDER BY score DESC))
            WHERE above IS NULL OR pos_below IS NULL OR pos_below <> pos OR neg_below <> neg UNION ALL SELECT NULL, 0, 0, 0, 0""",
            **{**_ROC, "g": _ROC["g"].replace("ROUND(Churn_Probability, 8)", "ROUND(ROUND(Churn_Probability, 8), 2)")},
        ),
    ),
    "roc_auc": (
        roc_auc,
        with_ctes(
            f"SELECT {r('SUM(pos * (n - fp) + pos * neg / 2.0::DOUBLE) / NULLIF(MAX(p) * MAX(n), 0)', 8)} AS roc_auc, MAX(p) AS positives, MAX(n) AS negatives FROM c",
            **_ROC,
        ),
    ),
}
