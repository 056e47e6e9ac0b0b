"""Boxes and the single-sentence rule on small cases that tell the branches apart."""

from pyspark.sql import functions as F

from quillspark.functions import geometry as geo
from quillspark.functions import text as tx


def box(x, y, w, h):
    return geo.Box(*[F.lit(float(v)) for v in (x, y, w, h)])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_labels_around_a_field(spark):
    field = box(100, 100, 50, 10)
    labels = {"above": box(100, 80, 40, 10), "below": box(100, 118, 40, 10), "left": box(60, 101, 30, 10), "right": box(155, 99, 30, 10)}
    gaps = {"above": 10.0, "below": 8.0, "left": 10.0, "right": 5.0}
    for side, label in labels.items():
        assert value(spark, geo.beside(field, label, side, 12.0, 1.0)) == gaps[side]
        assert value(spark, geo.beside(field, label, side, gaps[side] - 1, 1.0)) is None
        for other in set(labels) - {side}:
            assert value(spark, geo.beside(field, label, other, 12.0, 1.0)) is None
    # a small overlap counts as no gap, a larger one as no neighbour
    assert value(spark, geo.beside(field, box(100, 91, 40, 10), "above", 12.0, 1.0)) == 0.0
    assert value(spark, geo.beside(field, box(100, 93, 40, 10), "above", 12.0, 1.0)) is None


def test_areas_and_shapes(spark):
    assert value(spark, geo.share_inside(box(0, 0, 10, 10), box(5, 5, 10, 10))) == 0.25
    assert value(spark, geo.share_inside(box(0, 0, 10, 10), box(10, 0, 10, 10))) == 0.0
    assert value(spark, geo.share_inside(box(0, 0, 10, 10), box(2, 2, 0, 4))) == 0.0
    assert value(spark, geo.is_square(box(0, 0, 10, 11), 0.1)) and not value(spark, geo.is_square(box(0, 0, 0, 5), 0.1))
    assert value(spark, geo.gap(box(0, 0, 10, 1), box(10, 0, 5, 1), "x")) == 0.0 and value(spark, geo.gap(box(0, 0, 10, 1), box(9, 0, 5, 1), "x")) is None


def test_single_sentence(spark):
    want = {
        "": False, "   ": False, "Personal details": True, "One sentence.": True, "Single. two": False, "One. two": True,  # a word of up to four letters in front is a label
        "Ends here. Starts there.": False,
        "II. Personal details": True, "Valid from 01.05.2024 on.": True, "What?!": True, "EE. UU. and others.": True, "Yes. No. Maybe.": False, "a. b. c.": True,
    }
    rows = spark.createDataFrame(list(want.items()), "t string, want boolean").select("t", tx.is_single_sentence(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == want


def test_camel_case_is_cut_at_a_capital(spark):
    rows = spark.createDataFrame([("PersonalDetailsForm",), ("Short",), ("lowercaseonly",), ("ABc",)], "t string")
    got = {r.t: r.s for r in rows.select("t", tx.truncate_camel(F.col("t"), 10).alias("s")).collect()}
    assert got == {"PersonalDetailsForm": "Personal", "Short": "Short", "lowercaseonly": "lowercaseo", "ABc": "ABc"}
