from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from echofield.operators import sensors

XML = "<p><h><mission>S1</mission><v a='7'>1 2.5 x</v></h><orbit><t>1</t></orbit></p>"


def test_xml_fields(spark):
    products = spark.createDataFrame([(1, XML), (2, "<p/>")], "id int, text string")
    rows = sensors.xml_fields(products, "text", {"mission": ("p/h/mission", "string"), "v": ("p/h/v", "array<double>"), "a": ("p/h/v/@a", "int"), "none": ("p/q", "double")}).orderBy("id").collect()
    assert (rows[0].mission, rows[0].v, rows[0].a, rows[0].none) == ("S1", [1.0, 2.5, None], 7, None)
    assert rows[1].mission is None and rows[1].a is None


def test_xml_fields_are_those_of_each_path(spark):
    """Texts with several nodes, entities, CDATA sections, comments, blanks, or nothing, against a parse for each field."""
    texts = [
        XML, "<p/>", None, "", "<p><h><mission> S&amp;1&#233;</mission><mission>S2</mission><v a=''>1</v><v a='3'>2 3</v></h></p>", "<p><h><mission/><v>  </v></h></p>",
        "<p><h><mission>a<![CDATA[b]]>c</mission><v>1<![CDATA[ 2]]></v></h></p>", "<p><h><mission>a<!-- b -->c</mission><v>1<v/>2</v></h></p>",
        "<!DOCTYPE p [<!ENTITY e 'val'>]><p><h><mission>1&e;2</mission></h></p>", "<p xmlns='u'><h><mission>😀</mission><v>4\n5\t6</v></h></p>",
    ]
    paths = {"mission": ("p/h/mission", "string"), "v": ("p/h/v", "array<double>"), "a": ("p/h/v/@a", "string"), "n": ("p/h/v/@a", "int"), "u": ("//*[local-name()='mission']/text() | //v/@a", "string")}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    nodes = {k: F.xpath("text", F.lit(path if path.endswith("@a") else f"{path}/text()")) for k, (path, _) in paths.items()}
    # One at a time, as was done for all once.
    want = df.select("id", F.get(nodes["mission"], 0).alias("mission"), F.expr("transform(split(trim(array_join(xpath(text, 'p/h/v/text()'), ' ')), '\\\\s+'), x -> try_cast(x as double))").alias("v"), F.get(nodes["a"], 0).alias("a"), F.get(nodes["n"], 0).try_cast("int").alias("n"), F.get(nodes["u"], 0).alias("u"))
    got = sensors.xml_fields(df, "text", paths).drop("text")
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == sorted(map(tuple, want.collect()), key=lambda x: x[0])


def test_xml_is_parsed_once(spark):
    products = spark.range(3).select(F.format_string("<p><a>%d</a><b>1</b><c>2</c></p>", "id").alias("text"))
    plan = sensors.xml_fields(products, "text", {k: (f"p/{k}", "int") for k in "abc"})._jdf.queryExecution().optimizedPlan().toString()
    # Others are asked for only when there are sections.
    assert plan.count("concat(count(") == 1
    assert [tuple(x) for x in sensors.xml_fields(products, "text", {k: (f"p/{k}", "int") for k in "abc"}).drop("text").collect()] == [(k, 1, 2) for k in range(3)]


def test_json_fields(spark):
    row = sensors.json_fields(spark.createDataFrame([('{"c": {"f": 9.6}}',)], "text string"), "text", {"f": ("$.c.f", "double"), "g": ("$.g", "double")}).first()
    assert (row.f, row.g) == (9.6, None)


def test_position_polynomial(spark):
    states = spark.range(30).select((F.col("id") * 1.0).alias("t"), (7e6 - 2.0 * F.col("id") ** 2).alias("x"), (7500.0 * F.col("id")).alias("y"), (F.col("id") * 0.5 + 3).alias("z"))
    x, y, z = sensors.position_polynomial(states)
    assert x[:3] == pytest.approx([7e6, 0.0, -2.0], abs=1e-4) and y[1] == pytest.approx(7500.0) and z[:2] == pytest.approx([3.0, 0.5], abs=1e-5)


def test_surface_polynomial(spark):
    samples = spark.range(100).select((F.col("id") % 10 * 100.0).alias("x"), (F.floor(F.col("id") / 10) * 50.0).alias("y")).withColumn("v", 3 + 0.01 * F.col("x") - 0.002 * F.col("x") * F.col("y"))
    c = sensors.surface_polynomial(samples, "x", "y", "v", 2, 2)
    assert c[0][0] == pytest.approx(3, abs=1e-6) and c[1][0] == pytest.approx(0.01) and c[1][1] == pytest.approx(-0.002) and abs(c[2][2]) < 1e-9


def test_calibration_and_noise(spark):
    tables = spark.createDataFrame([(1, [2.0, 2.0]), (1, [2.0]), (2, [2.0, 3.0])], "id int, lut array<double>")
    assert {x.id: x.beta0 for x in sensors.constant_calibration(tables, "id", "lut").collect()} == {1: 0.25, 2: None}
    vectors = spark.createDataFrame([(0, list(range(0, 100, 5)), [10 ** (0.1 * (1 + 0.02 * p)) for p in range(0, 100, 5)])], "burst int, pixels array<int>, lut array<double>")
    fit = sensors.noise_polynomials(vectors, "burst", "pixels", "lut", 2)[0]
    assert fit[:2] == pytest.approx([1.0, 0.02], abs=1e-6)


def test_bursts(spark):
    rows = sensors.bursts(spark.createDataFrame([(25, 10)], "lines int, per int"), "lines", "per").collect()
    assert [(x.burst, x.first_line) for x in rows] == [(0, 0), (1, 10), (2, 20)]
    assert math.isfinite(rows[0].first_line)
