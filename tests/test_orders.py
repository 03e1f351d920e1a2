"""Order rules on hand-made accounts."""

from pyspark.sql import functions as F

from tidepanel.operators import orders as K
from tidepanel.operators.factors import FactorConfig


def run(spark, w, pos, px, equity=1000.0, **kw):
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    return K.propose_orders(mk([(1, s, v) for s, v in w.items()], "account_id long, symbol string, weight double"), mk([(1, equity)], "account_id long, equity double"),
                            mk([(1, s, q) for s, q in pos.items()], "account_id long, symbol string, qty double"),
                            mk(list(px.items()), "symbol string, price double"), **kw).orderBy("seq").collect()


def test_fresh_account(spark):
    o = run(spark, {"A": 0.5, "B": -0.5, "C": 0.0}, {"Z": 5.0}, {"A": 30.0, "B": 70.0, "C": 1.0})
    assert [(r["symbol"], r["side"], r["qty"], r["action"], r["notional"]) for r in o] == [("A", "buy", 16.0, "open long", 480.0), ("B", "sell", 7.0, "open short", 490.0)]


def test_crossing_splits_and_reductions_come_first(spark):
    o = run(spark, {"A": -0.3, "B": 0.2, "C": 0.0}, {"A": 5.0, "B": 30.0, "C": -4.0}, {"A": 10.0, "B": 10.0, "C": 10.0})
    assert [(r["symbol"], r["action"], r["qty"]) for r in o] == [("A", "close long", 5.0), ("B", "reduce long", 10.0), ("C", "close short", 4.0), ("A", "open short", 30.0)]


def test_small_moves_are_skipped_but_crossings_kept(spark):
    assert run(spark, {"A": 0.1}, {"A": 99.0}, {"A": 1.0}, min_notional=5.0) == []
    o = run(spark, {"A": -0.002}, {"A": 1.0}, {"A": 2.0}, min_notional=3.0)
    assert [r["action"] for r in o] == ["close long", "open short"]


def test_last_rebalance_and_due(spark):
    rows = [(1, "p-20200103-A-open-long", "5"), (1, "p-20200109-B-open-long", "0"), (1, "p-20201399-B-x", "4"), (1, None, "4"), (1, "q-20210101-A-x", "3"), (2, "p-20200106-C-x", "zz")]
    h = spark.createDataFrame(rows, "account_id long, client_order_id string, filled string")
    last = K.last_rebalance(h, "p")
    got = {r["account_id"]: r["last_rebalance"] for r in last.collect()}
    assert str(got[1]) == "2020-01-03" and got[2] is None
    cal = spark.range(10).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"), F.col("id").cast("int").alias("t"))
    due = {r["account_id"]: (r["days_since"], r["due"]) for r in K.rebalance_due(last, cal, F.lit("2020-01-08").cast("date"), 5).collect()}
    assert due == {1: (5, 1), 2: (None, 1)}


def state_plan(spark, accounts, positions, fit, stocks):
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    return K.stateful_plan(mk(fit, "strategy string, symbol string, s double, eligible boolean, beta double, hedge string, kappa double, sigma_eq double"),
                           mk(accounts, "account_id long, strategy string, equity double"), mk(positions, "account_id long, symbol string, qty double"),
                           mk([(s, p) for s, p, _, _ in stocks], "symbol string, price double"), mk([(s, b) for s, _, b, _ in stocks], "symbol string, shortable boolean"),
                           mk([(s, f) for s, _, _, f in stocks], "symbol string, fund string"), FactorConfig())


STOCKS = [("A", 10.0, True, "F0"), ("B", 20.0, False, "F0"), ("C", None, True, "F1"), ("D", 5.0, None, "F1"), ("E", 1e6, True, "F0")]
FIT = [("x", "A", -2.0, True, 1.0, "F0", 9.0, 0.1), ("x", "B", 2.0, True, 1.0, "F0", 9.0, 0.1), ("x", "C", -2.0, True, 1.0, "F1", 9.0, 0.1), ("x", "D", 2.0, True, 1.0, "F1", 9.0, 0.1),
       ("x", "E", -2.0, True, 1.0, "F0", 9.0, 0.1), ("y", "A", 0.0, True, 1.0, "F0", 9.0, 0.1), ("y", "D", -2.0, False, 1.0, "F1", 9.0, 0.1)]


def test_state_plan_has_held_and_opening_pairs(spark):
    plan = state_plan(spark, [(1, "x", 1e4), (2, "x", 1e4), (3, "y", 1e4)], [(1, "A", 7.0), (2, "C", 3.0), (3, "A", 5.0), (3, "B", 0.0)], FIT, STOCKS)
    got = {(r["account_id"], r["symbol"]): (r["before"], r["after"], r["target"], r["skipped"], r["blind"]) for r in plan.collect()}
    size = FactorConfig().position * 1e4
    assert got == {(1, "A"): (1, 1, 7.0, None, False), (1, "B"): (0, 0, 0.0, "no borrow", False), (1, "D"): (0, -1, -float(size // 5), None, False),
                   (1, "E"): (0, 0, 0.0, "too dear", False),
                   # a blind holding freezes its fund for that account: D, hedged by it, is not opened
                   (2, "A"): (0, 1, float(size // 10), None, False), (2, "B"): (0, 0, 0.0, "no borrow", False), (2, "C"): (0, 0, None, None, True),
                   (2, "D"): (0, 0, 0.0, "hedge frozen", False), (2, "E"): (0, 0, 0.0, "too dear", False),
                   # another strategy: no opener, and the score of zero closes the holding
                   (3, "A"): (1, 0, 0.0, None, False)}


def test_state_plan_never_meets_the_universe(spark):
    plan = state_plan(spark, [(1, "x", 1e4)], [(1, "A", 7.0)], FIT, STOCKS)
    text = plan._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text and "_slice" not in text
