import random
from datetime import datetime, timedelta
from decimal import Decimal as D

from fibrelens.operators import wallet
from tests.helpers import by


def old(partner, when, delta=1, balance=1, **more):
    return dict(partner_id=partner, added_at_ist=when, credit_delta=delta, balance=balance, **more)


def new(partner, when, before=0, balance=1, **more):
    return dict(partner_id=partner, added_time=when, old_balance=before, balance=balance, **more)


def statement(table, olds, news, n=100):
    return wallet.wallet_transactions(table("ledger_old", olds), table("ledger_new", news), n)


def test_hand_over(table):
    olds = [old(1, "2024-01-01 00:00:00", remark="o1"), old(1, "2024-01-02 00:00:00", remark="o2"), old(3, "2024-01-02 00:00:00", remark="o3")]
    news = [
        new(1, "2024-01-01 23:00:00", remark="before"),  # 04:30 local on the 2nd, but compared as stored
        new(1, "2024-01-02 00:00:00", remark="at"),
        new(1, "2024-01-02 00:00:01", remark="after", before=10, balance=4),
        new(2, "1999-12-31 23:00:00", remark="ancient"),
        new(2, "2000-01-01 00:00:01", remark="kept"),
        new(None, "2024-01-01 00:00:00"),
    ]
    rows = statement(table, olds, news).collect()
    assert [(r.partner_id, r.row_no, r.remark) for r in sorted(rows, key=lambda r: (r.partner_id, r.row_no))] == [
        (1, 1, "after"),
        (1, 2, "o2"),
        (1, 3, "o1"),
        (2, 1, "kept"),
        (3, 1, "o3"),
    ]
    after = next(r for r in rows if r.remark == "after")
    assert (after.credit_delta, after.added_at_ist) == (D("-6.00"), datetime(2024, 1, 2, 5, 30, 1))


def test_equals_the_full_statement_with_a_hot_partner(spark, table):
    """Against a plain evaluation: full union, full hand-over, full sort."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    olds, news = [], []
    for i in range(3000):
        partner = 1 if rng.random() < 0.4 else rng.randrange(2, 40)
        when = start + timedelta(minutes=30 * rng.randrange(2000))
        row = dict(partner_id=partner, action="a", remark=f"r{i}", balance=rng.randrange(100))
        if rng.random() < 0.5:
            olds.append(row | dict(added_at_ist=str(when), credit_delta=rng.randrange(-5, 6)))
        else:
            news.append(row | dict(added_time=str(when + timedelta(days=10)), old_balance=rng.randrange(100)))
    a = table("ledger_old", olds).repartition(7)
    b = table("ledger_new", news).repartition(5)
    got = {}
    for r in wallet.wallet_transactions(a, b, 20).collect():
        got.setdefault(r.partner_id, []).append((r.row_no, r.remark))

    last_old = {}
    for r in olds:
        last_old[r["partner_id"]] = max(last_old.get(r["partner_id"], ""), r["added_at_ist"])
    full = {}
    for r in olds:
        full.setdefault(r["partner_id"], []).append((r["added_at_ist"], False, r["remark"]))
    for r in news:
        if r["added_time"] > last_old.get(r["partner_id"], "2000-01-01"):
            local = str(datetime.fromisoformat(r["added_time"]) + timedelta(minutes=330))
            full.setdefault(r["partner_id"], []).append((local, True, r["remark"]))
    want = {p: [(i + 1, x[2]) for i, x in enumerate(sorted(rows, reverse=True)[:20])] for p, rows in full.items()}
    assert {p: sorted(rows) for p, rows in got.items()} == want
    assert len(want[1]) == 20


def test_summary_and_report(table):
    olds = [old(1, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", delta=1, balance=i) for i in range(120)]
    news = [
        new(1, "2024-02-01 00:00:00", before=100, balance=40.5, remark="x" * 90, action="OUT"),
        new(1, "2024-02-02 00:00:00", before=7, balance=7, action="NONE"),
        new(2, "2024-02-02 00:00:00", before=None, balance=None),
    ]
    rows = statement(table, olds, news)
    got = by(wallet.wallet_summary(rows), "partner_id")
    assert tuple(got[1].values())[1:] == (D("7.00"), D("98.00"), D("59.50"), 100)
    assert tuple(got[2].values())[1:] == (0, 0, 0, 1)
    shown = by(wallet.wallet_report(rows), "partner_id", "#")
    assert (shown[1, 2]["Amount"], shown[1, 2]["Balance After"], len(shown[1, 2]["Remark"])) == ("-₹59.50", "₹40.50", 80)
    assert (shown[1, 1]["Amount"], shown[1, 1]["Date & Time (IST)"], shown[1, 1]["Remark"]) == ("₹0", "2024-02-02 05:30:00", "")
    assert shown[1, 3]["Amount"] == "+₹1.00"
    assert (shown[2, 1]["Amount"], shown[2, 1]["Balance After"]) == ("₹0", "₹0.00")


def test_rows_are_ranked_by_instant_where_clocks_change(table):
    """In Berlin the hour from 02:00 came twice on 2024-10-27 (first from 00:00 UTC, again from 01:00 UTC)."""
    news = [new(1, "2024-10-27 00:45:00", remark="first pass"), new(1, "2024-10-27 01:10:00", remark="second pass"), new(1, "2024-10-27 02:00:00", remark="after")]
    olds = [old(1, "2024-10-26 23:00:00", remark="before")]
    rows = wallet.wallet_transactions(table("ledger_old", olds), table("ledger_new", news), zone="Europe/Berlin").orderBy("row_no").collect()
    assert [(r.remark, str(r.added_at_ist)) for r in rows] == [
        ("after", "2024-10-27 03:00:00"),
        ("second pass", "2024-10-27 02:10:00"),
        ("first pass", "2024-10-27 02:45:00"),
        ("before", "2024-10-26 23:00:00"),
    ]
