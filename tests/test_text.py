import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import pytext as P
from docloom.functions import text as T

DATES = [("24 - 09 1992", "1992-09-24"), ("ngày 07 tháng 11 năm 2024", "2024-11-07"), ("ngày l9 tháng 1O năm 2012", "2012-10-19"), ("x ngawdate 3 mang 4 nam 2001.", "2001-04-03"), ("40/13/2020 01/01/2020", None), ("31-02-2020", "2020-02-31"), ("", None)]
SEXES = [("Sex Nam Quốc tịch Việt Nam", "Nam"), ("Quốc tịch Việt Nam", ""), ("Sox Nữ", "Nữ"), ("F", "Nữ"), ("male", "Nam"), ("", "")]
TEXTS = ["Họ và tên / Full name", "Nơi ĐKHK thưng tru Xã Mẫu", " 12 , 34 : 56 ", "-83 060977.", "Đường Ễ ß", "", "·…..  x"]


@pytest.mark.parametrize(("text", "iso"), DATES)
def test_dates(text, iso):
    assert P.to_iso(text) == iso


def test_columns_agree_with_python(spark):
    texts = TEXTS + [t for t, _ in DATES + SEXES]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    names = list(T.NORMALIZERS)
    got = rows.select("t", T.key(c).alias("key"), T.to_iso(c).alias("iso"), T.after_colon(c).alias("colon"), *(T.NORMALIZERS[n](c).alias(n) for n in names)).collect()
    for r in got:
        assert (r["key"], r["iso"], r["colon"]) == (P.key(r["t"]), P.to_iso(r["t"]), P.after_colon(r["t"]))
        for n in names:
            assert r[n] == P.NORMALIZERS[n](r["t"]), (n, r["t"])


@given(st.text(max_size=12), st.text(max_size=12), st.integers(0, 3))
def test_distance_within(a, b, most):
    table = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    assert P.distance_within(a, b, most) == (table[len(a), len(b)] <= most)


def test_codes(spark):
    rows = spark.createDataFrame([("4e475559e1bb844e",), ("abc",), ("zz",), ("ff",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.hex_to_text(F.col("t"))).collect()] == ["NGUYỄN", None, None, None, None, None]
