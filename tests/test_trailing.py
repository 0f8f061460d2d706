import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

from millrace.operators import trailing

ROW = "source_file_id string, source_row_number int, customer_id string, quantity int, unit_price string, transaction_timestamp string"


def test_against_brute_force(spark):
    r = random.Random(2)
    data = []
    for k in range(700):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=r.choice([r.randint(0, 100), r.randint(40, 44)]))
        stamp = r.choice([f"{day}T10:00:00+05:00", f"{day} 23:59:59", day.strftime("%Y%m%dT101500"), str(day)])
        data.append(("f", k, r.choice(["100010", "1000101", "7", None, "guest"]), r.choice([1, 50, -3, None]), r.choice(["12.3456", "99", "-4.5", "9.99 ", "", None]), stamp))
    data += data[:40]  # delivered twice
    daily = defaultdict(Decimal)
    for _, _, c, q, p, t in dict.fromkeys(data):
        if c in ("100010", "1000101") and q is not None and p in ("12.3456", "99", "-4.5"):
            digits = t.replace("-", "")[:8]
            daily[c, dt.date(int(digits[:4]), int(digits[4:6]), int(digits[6:]))] += q * Decimal(p)
    want = {}
    for c in ("100010", "1000101"):
        days = [d for e, d in daily if e == c]
        d = min(days)
        while d <= max(days):
            sums = [sum((daily.get((c, d - dt.timedelta(days=k)), Decimal(0)) for k in range(n)), Decimal(0)) for n in (7, 30)]
            want[c, d] = ((d - min(days)).days + 1, *sums)
            d += dt.timedelta(days=1)
    rolled = trailing.trailing_totals(trailing.daily_sales(spark.createDataFrame(data, ROW)))
    got = {(x.customer_id, x.day): (x.day_number, x.total_7, x.total_30) for x in rolled.collect()}
    assert got == want
    found = {tuple(x) for x in trailing.surges(rolled, least=100).collect()}
    assert found == {(c, str(d)) for (c, d), (n, a, b) in want.items() if n >= 30 and a >= 100 and b > 0 and a * 30 >= 21 * b}
    assert found


def test_empty_and_unreadable(spark):
    assert trailing.trailing_totals(trailing.daily_sales(spark.createDataFrame([], ROW))).count() == 0
    bad = spark.createDataFrame([("f", 1, "100010", 1, "1", None), ("f", 2, "100010", 1, "1", "2024-02-30"), ("f", 3, "100010", 1, "1", "soon")], ROW)
    assert trailing.daily_sales(bad).count() == 0


def test_prices_beyond_exact_sums_are_counted(spark):
    prices = ["1.5", "00000000000000001.50000000000000000000", "99999999999", "100000000000", "1.12345678901234567", "-3"]
    rows = spark.createDataFrame([("f", k, "100010", 2, p, "2024-01-01") for k, p in enumerate(prices)], ROW)
    day = trailing.daily_sales(rows).first()
    assert (day.n_rows, day.n_beyond, day.total) == (6, 2, 2 * (Decimal("3.0") + Decimal(99999999999) - 3))
