import math
import random
from collections import Counter, defaultdict

from millrace.operators import quality

ROW = "load_id long, client_id string, customer_id string, product_description string, unit_price string, quantity int, n long"


def data(seed=4, n=900):
    r = random.Random(seed)
    return [
        (load := r.choice([1, 1, 1, 2, 3, 5, None]), "a" if load in (1, 3, None) else "b", r.choice(["100010", "12", " ", None]), r.choice(["MUG", "MUG  BIG", "Mug", "", None, "A"]),
         r.choice(["1.5", "1.50", "2", "x", "", None, "-3"]) if load != 3 else r.choice(["9", "8"]), r.choice([1, 2, 3, 99999, None]), k)
        for k in range(n)
    ]


def test_profile_is_exact(spark):
    rows = data()
    got = {(r.load_id, r.column_name): r for r in quality.profile(spark.createDataFrame(rows, ROW).repartition(6)).collect()}
    cols = {"customer_id": 2, "product_description": 3, "unit_price": 4, "quantity": 5}
    loads = {r[0] for r in rows}
    assert set(got) == {(x, c) for x in loads for c in cols}
    values = defaultdict(list)
    for r in rows:
        for c, k in cols.items():
            values[r[0], c].append(None if r[k] is None else str(r[k]))
    prior = {3: 1, 5: 2}

    def sortable(key):
        full = [v for v in values[key] if v is not None and v.strip()]
        return sorted(float(v) for v in full if v != "x") if key[1] in ("unit_price", "quantity") else sorted(full)

    for key, own in values.items():
        g, s = got[key], sortable(key)
        full = [v for v in own if v is not None and v.strip()]
        assert (g.n_rows, g.n_blank, g.n_distinct) == (len(own), len(own) - len(full), len(set(full)))
        for q, name in ((0.0, "least"), (0.25, "lower"), (0.5, "median"), (1.0, "most")):
            want = s[max(1, math.ceil(q * len(s))) - 1]
            have = g[f"{name}_number"] if key[1] in ("unit_price", "quantity") else g[f"{name}_text"]
            assert (float(have) if isinstance(want, float) else have) == want
        if key[0] in prior:
            t = sortable((prior[key[0]], key[1]))
            a, b = Counter(s), Counter(t)
            fa = fb = ks = 0
            for v in sorted({*a, *b}):
                fa, fb = fa + a[v] / len(s), fb + b[v] / len(t)
                ks = max(ks, abs(fa - fb))
            assert abs(g.ks_distance - ks) < 1e-12
        else:
            assert g.ks_distance is None


def test_shifts(spark):
    base = [(1, "c", "100010", "MUG", "1.00", 1, k) for k in range(100)]
    base = [(*r[:3], f"MUG {k % 10}", *r[4:]) for k, r in enumerate(base)]
    later = [(2, "c", "100010" if k >= 15 else None, f"MUG {k % 20}", "2.00" if k >= 3 else "2.00 ", 1 if k else 10001, k) for k in range(100)]
    found = {tuple(r) for r in quality.shifts(quality.profile(spark.createDataFrame(base + later, ROW), {"median": 0.5}, False)).collect()}
    assert found == {(2, "customer_id", "null_rate"), (2, "unit_price", "form"), (2, "unit_price", "median"), (2, "product_description", "distinct"), (2, "quantity", "range")}


def test_empty_and_all_blank(spark):
    assert quality.profile(spark.createDataFrame([], ROW)).count() == 0
    blank = spark.createDataFrame([(1, None, None, " ", "", None, 1), (2, None, None, None, None, None, 2)], ROW)
    out = quality.profile(blank)
    assert out.count() == 8 and quality.shifts(out).count() == 0


def test_numbers_beyond_exact_ones_are_counted(spark):
    prices = ["1", "2", "9" * 23, "1.12345678901234567", "00" + "9" * 22, "2.50000000000000000000", "x"]
    row = quality.profile(spark.createDataFrame([(1, "c", "100010", "A", p, 1, 1) for p in prices], ROW)).where("column_name = 'unit_price'").first()
    assert (row.n_rows, row.n_off_form, row.n_beyond, row.n_sorted, int(row.most_number)) == (7, 1, 2, 4, int("9" * 22))
