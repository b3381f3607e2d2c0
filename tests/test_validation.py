from __future__ import annotations

from echofield.operators import validation

GOOD = dict(mode="SPOTLIGHT", coa_scalar=True, row_sgn=-1, col_sgn=-1, row_dk1=-0.5, row_dk2=0.5, row_ss=0.9, row_bw=1.0, algorithm="PFA", grid="RGAZIM", scp_time=2.0, coa_constant=2.0, polar_reference=2.0, duration=4.0, tx_bandwidth=100.0, tx_length=10.0, tx_rate=10.0)


def found(spark, **changes):
    row = {"id": 1, **GOOD, **changes}
    schema = ", ".join(f"{k} {'boolean' if isinstance(GOOD.get(k, v), bool) else 'string' if isinstance(GOOD.get(k, v), str) else 'double' if isinstance(GOOD.get(k, v), float) else 'int'}" for k, v in row.items())
    return {x.rule for x in validation.validate(spark.createDataFrame([tuple(row.values())], schema), "id").collect()}


def test_good_metadata_pass(spark):
    assert found(spark) == set()


def test_each_fault_is_found(spark):
    assert found(spark, coa_scalar=False) == {"spotlight_coa"}
    assert found(spark, col_sgn=1) == {"sgn"}
    assert found(spark, row_dk2=-0.6) == {"row_dk_order", "row_bw"}
    assert found(spark, row_bw=1.2) == {"row_bw"}
    assert found(spark, row_ss=1.1) == {"row_dk1", "row_dk2"}
    assert found(spark, grid="RGZERO") == {"pfa_grid"}
    assert found(spark, scp_time=3.9) == {"scp_time", "pfa_reference", "scp_middle"}
    assert found(spark, tx_rate=12.0) == {"tx_bandwidth"}


def test_unknown_is_not_wrong(spark):
    assert found(spark, col_sgn=None, grid=None, tx_rate=None, polar_reference=None) == {"pfa_block"}
