"""Dates by shape equal dates by trying every pattern."""

import random

from pyspark.sql import functions as F

from sparkeda.functions.values import DATE_FORMATS
from sparkeda.operators import clean as cl


def _values():
    r = random.Random(4)
    out = {"", "20240105", "99999999", "2024-13-01", "2024-02-30", "May 5, 2020", "Mar 15, 2020", "March 15, 2020", "may 5, 2020",
           "5 May 2020", "05 Sept 2020", "5 September 2020", "2024-01-05T10:11:12Z", "2024-01-05T10:11:12+02:00", "2024-01-05t10:11:12",
           "2024-01-05T10:11:12.123-05:00", "1/2/2020", "01/02/2020", "13/02/2020", "1/2/2020 3:04", "1/02/2020 13:04:05",
           "01/02/2020 23:04:05", "2024-01-05 10:11", "2024-01-05 10:11:12.123456", "2024-01-05 10:11:12.123", "31-12-1999", "1999/12/31",
           "no", "yes", "x" * 60, "٠١/٠٢/٢٠٢٠", "2024-01-05 ", " 2024-01-05", "Jan 1, 1850", "0000-00-00"}
    parts = ["2024", "1", "01", "12", "31", "Jan", "January", "-", "/", " ", ":", "T", ", ", "00", "59", "Z"]
    return sorted(out | {"".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(400)})


def test_every_value_parses_as_with_all_patterns(spark):
    df = spark.createDataFrame([(v,) for v in _values()] + [(None,)], "v string")
    tried = df.select("v", F.array(*[F.struct(F.lit(j).alias("j"), F.year(cl.parse_with(F.col("v"), f)).alias("y"))
                                     for j, f in enumerate(DATE_FORMATS)]).alias("dates"))
    want = {r["v"]: {(d["j"], d["y"]) for d in r["dates"] if d["y"] is not None} for r in tried.collect()}
    got = {r["v"]: {(d["j"], d["y"]) for d in r["dates"]} for r in cl.with_dates(df, DATE_FORMATS).collect()}
    assert got == want and sum(map(bool, want.values())) > 15


def test_the_dictionary_is_small_and_mostly_one_parse():
    shapes = {}
    for f in DATE_FORMATS:
        for s in cl.format_shapes(f):
            shapes.setdefault(s, set()).add(cl._loose(f))
    assert len(shapes) < 200 and max(map(len, shapes.values())) == 2
    assert sum(len(x) == 2 for x in shapes.values()) == 4          # short or whole month names of three letters
