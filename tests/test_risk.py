import pytest

from timbrewatch.config import RiskConfig
from timbrewatch.operators import risk, trials


def test_missing_factor_moves_its_weight(spark):
    rows = spark.sql("select * from values (1, 0.8D, 0.5D), (2, 0.8D, null), (3, null, 0.5D), (4, null, null)"
                     " as t(id, spoof_prob, speaker_sim)")
    got = {r["id"]: r for r in risk.verdicts(rows, RiskConfig()).collect()}
    assert got[1]["risk_score"] == pytest.approx(0.7 * 0.8 + 0.3 * 0.5)
    assert got[2]["risk_score"] == pytest.approx(0.8) and got[2]["action"] == "block"
    assert got[3]["risk_score"] == pytest.approx(0.5) and got[3]["tier"] == "MEDIUM"
    assert got[4]["risk_score"] is None and got[4]["tier"] is None and got[4]["action"] is None


def test_configuration_from_a_table(spark):
    table = spark.sql("select * from values ('high', 0.9D), ('unknown', 5D) as t(param, value)")
    cfg = RiskConfig.from_table(table)
    assert cfg.high == 0.9 and cfg.medium == RiskConfig().medium
    rows = spark.sql("select 0.9D as risk_score union all select 0.89D")
    assert sorted(r["tier"] for r in risk.tier(rows, cfg).collect()) == ["HIGH", "MEDIUM"]


def test_perfect_scores_have_full_area(spark):
    rows = spark.sql("select * from values ('synthetic', 0.9D), ('synthetic', 0.8D), ('authentic', 0.2D), ('authentic', 0.1D)"
                     " as t(truth, risk_score)")
    row = trials.roc_summary(trials.roc(rows)).first()
    assert row["auc"] == pytest.approx(1.0) and row["eer"] == pytest.approx(0.0) and row["eer_threshold"] == 0.8
