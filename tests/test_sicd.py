from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.operators import sensors
from echofield.plans import views
from echofield.sources import probe, sicd

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["RE32F_IM32F", "RE16I_IM16I", "AMP8I_PHS8I"])
def test_round_trip_over_segments(spark, tmp_path, kind):
    sicd.registered(spark)
    px = views.pixels(spark, SF).where("r < 25 and r <> 9").select("r", "c", (F.col("re") * 100).alias("re"), (F.col("im") * 100).alias("im"))
    path = str(tmp_path / "x.ntf")
    sicd.write_sicd(px, path, 26, 32, kind, segment_rows=10)
    image = sicd.read_image(path)
    assert [s.rows for s in image.segments] == [10, 10, 6] and image.rows == 26
    got = {(x.r, x.c): complex(x.re, x.im) for x in spark.read.format("sicd").load(path).collect()}
    want = {(x.r, x.c): complex(x.re, x.im) for x in px.collect()}
    assert len(got) == 26 * 32 and got[9, 0] == got[25, 31] == 0
    close = {"RE32F_IM32F": 1e-4, "RE16I_IM16I": 0.71, "AMP8I_PHS8I": 4.0}[kind]
    assert all(abs(got[k] - v) < close for k, v in want.items())
    part = spark.read.format("sicd").option("rowstride", 3).load(path).where("r > 7 and r <= 21 and c < 2")
    assert sorted((x.r, x.c) for x in part.collect()) == [(r, c) for r in (9, 12, 15, 18, 21) for c in (0, 1)]


def test_metadata_and_sniffing(spark, tmp_path):
    path = str(tmp_path / "x.ntf")
    sicd.write_sicd(views.pixels(spark, SF).where("r < 3"), path, 3, 32)
    assert [x.format for x in probe.sniffed(spark, str(tmp_path)).collect()] == ["sicd"]
    fields = {"rows": ("//*[local-name()='NumRows']", "int"), "kind": ("//*[local-name()='PixelType']", "string")}
    row = sensors.xml_fields(sicd.metadata(spark, [path]), "xml", fields).first()
    assert (row.rows, row.kind) == (3, "RE32F_IM32F")
    assert np.isclose(sicd.read_image(path).cols, 32)
    with pytest.raises(ValueError):
        sicd.read_image(f"{SF}/region.parquet")
