"""A larger generated log: variants, groups and scoped limits against plain Python."""

import random
import re
from collections import Counter

import pytest

from loomtrace.store import Store

ACTIVITIES = ["book", "load", "sail", "call at port", "repair", "unload", "pay off"]


def voyages(seed, traces=120):
    r = random.Random(seed)
    base = [[r.choice(ACTIVITIES) for _ in range(r.randint(1, 12))] for _ in range(30)]
    out = []
    for t in range(traces):
        steps = list(r.choice(base))
        if r.random() < 0.4:
            r.shuffle(steps)
        out.append((f"V{t}", [(a, f"20{r.randint(10, 20)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T0{r.randint(0, 9)}:00:00.000+00:00", round(r.random() * 900, 2) if r.random() < 0.9 else None, r.choice(["Fleet N", "Fleet S", "charter"])) for a in steps]))
    return out


def as_xes(name, log):
    out = [f'<log><classifier name="Activity" keys="concept:name lifecycle:transition"/><string key="concept:name" value="{name}"/>']
    for t, events in log:
        out.append(f'<trace><string key="concept:name" value="{t}"/><int key="size" value="{len(events)}"/>')
        for a, ts, total, who in events:
            cost = f'<float key="cost:total" value="{total}"/>' if total is not None else ""
            out.append(f'<event><string key="concept:name" value="{a}"/><date key="time:timestamp" value="{ts}"/><string key="lifecycle:transition" value="complete"/><string key="org:resource" value="{who}"/>{cost}</event>')
        out.append("</trace>")
    return "".join(out) + "</log>"


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("voyages")
    data = {"A": voyages(1), "B": voyages(2, 40)}
    (folder / "in").mkdir()
    for name, log in data.items():
        (folder / "in" / f"{name}.xes").write_text(as_xes(name, log))
    store = Store(spark, str(folder / "store"))
    store.import_log(str(folder / "in"))
    return store, data


def rows(store, text):
    return [tuple(r) for r in store.query(text).collect()]


def test_counts(logs):
    store, data = logs
    assert rows(store, "select count(l:name), count(t:name), count(e:name) where l:name = 'A'")[0][:3] == (1, 120, sum(len(e) for _, e in data["A"]))
    assert sum(r[-1] for r in rows(store, "select e:name, count(e:name) group by e:name")) == sum(len(e) for log in data.values() for _, e in log)
    assert {r[0]: r[1] for r in rows(store, "select t:name, count(e:name) where l:name = 'B' group by t:name")} == {t: len(e) for t, e in data["B"]}


@pytest.mark.parametrize("text,key", [("group by ^e:name", lambda e: tuple(x[0] for x in e)), ("group by ^e:name order by name", lambda e: tuple(sorted(x[0] for x in e))), ("group by [^e:c:Activity]", lambda e: tuple(x[0] + "+complete" for x in e))])
def test_variants(logs, text, key):
    store, data = logs
    got = {tuple(r[0]): r[-1] for r in rows(store, f"select count(t:name) where l:name = 'A' {text}")}
    assert got == Counter(key(e) for _, e in data["A"]) and sum(got.values()) == 120


def test_variants_of_two_logs_never_mix(logs):
    store, data = logs
    got = rows(store, "select count(t:name) group by l:name, ^e:name")
    want = Counter((name, tuple(x[0] for x in e)) for name, log in data.items() for _, e in log)
    assert {(r[1], tuple(r[0])): r[-1] for r in got} == want
    assert [r[-1] for r in got] == sorted((r[-1] for r in got), reverse=True)


def test_variants_ordered_by_time(logs):
    store, data = logs
    got = {tuple(r[0]): r[-1] for r in rows(store, "select count(t:name) where l:name = 'A' group by ^e:name order by e:timestamp")}
    assert got == Counter(tuple(x[0] for x in sorted(e, key=lambda x: x[1])) for _, e in data["A"])


def scan(data, order, limit, offset):
    """The scoped limits, one row after another."""
    flat = [(name, t, i, *e) for name, log in data.items() for t, events in log for i, e in enumerate(events)]
    flat = [(*x, n) for n, x in enumerate(flat)]
    flat.sort(key=order)
    logs, traces, events, out = {}, {}, Counter(), []
    for x in flat:
        l = logs.setdefault(x[0], len(logs))
        own = traces.setdefault(x[0], {})
        t = own.setdefault(x[1], len(own))
        e = events[x[:2]]
        events[x[:2]] += 1
        if all(offset.get(s, 0) <= v < offset.get(s, 0) + limit.get(s, 10**9) for s, v in (("l", l), ("t", t), ("e", e))):
            out.append((x[1], x[3]))
    return out


@pytest.mark.parametrize("clause,limit,offset", [("limit l:1, t:4, e:3", {"l": 1, "t": 4, "e": 3}, {}), ("limit t:3 offset t:2, e:1", {"t": 3}, {"t": 2, "e": 1}), ("limit e:1 offset l:1", {"e": 1}, {"l": 1}), ("offset t:112", {}, {"t": 112})])
@pytest.mark.parametrize("order,key", [("", lambda x: x[-1]), ("order by e:total desc", lambda x: (x[5] is None, -(x[5] or 0), x[-1])), ("order by e:resource, e:timestamp", lambda x: (x[6], x[4], x[-1]))])
def test_scoped_limits(logs, clause, limit, offset, order, key):
    store, data = logs
    got = rows(store, f"select t:name, e:name {order} {clause}")
    want = scan(data, key, limit, offset)
    assert (got if order else sorted(got)) == (want if order else sorted(want))


def test_weighted_parent_aggregates_and_expressions(logs):
    store, data = logs
    sizes = [len(e) for log in data.values() for _, e in log for _ in e]
    got = rows(store, "select avg(t:size), max(t:size) - min(t:size), count(t:size), round(avg(t:size) * 10), count(e:name)")[0]
    mean = sum(sizes) / len(sizes)
    assert abs(got[0] - mean) < 1e-9 and got[1] == max(sizes) - min(sizes) and got[2] == len(set(sizes)) and got[3] == int(mean * 10 + 0.5)
    assert abs(rows(store, "select avg(t:size)")[0][0] - sum(len(e) for log in data.values() for _, e in log) / 160) < 1e-9


def test_joins_with_traces_shuffle_no_maps(logs):
    store, data = logs
    for text in ("select count(t:name), sum(e:total)", "select e:name, t:name, e:total where e:total > 5 or t:size = 3", "select count(e:name) group by [e:c:Activity]", "select [e:c:Activity], t:name"):
        lines = store.query(text)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joined = [i for i, line in enumerate(lines) if "Join LeftOuter" in line and "_trace#" in line]
        below = [next(x for x in lines[i + 1 :] if "Project [" in x) for i in joined]
        assert below and not any(re.search(r"(?:\[|, )(?:attrs#\d+ AS )?e_attrs#\d+(?:,|\])", x) for x in below), (text, below)
    texts = sorted(r[0] for r in rows(store, "select [e:COST:Total] where l:name = 'A' and t:size = 1 and [e:Cost:total] > 0"))
    assert texts == sorted(str(x) for _, events in data["A"] if len(events) == 1 for _, _, x, _ in events if x)


def test_classifiers_take_parts_from_any_level(spark, tmp_path):
    event = lambda *a: "<event>" + "".join(f'<{t} key="{k}" value="{v}"/>' for t, k, v in a) + "</event>"
    log = '<log><classifier name="Whole" keys="step ship size line"/><string key="line" value="L"/>'
    log += '<trace><string key="ship" value="S"/><int key="size" value="3"/>' + event(("string", "step", "a"), ("string", "ship", "own")) + event(("string", "step", ""), ("float", "size", "0.5")) + event(("string", "Whole", "x")) + "</trace>"
    log += "<trace>" + event(("boolean", "step", "true")) + "</trace></log>"
    (tmp_path / "log.xes").write_text(log)
    for parents in (False, True):
        store = Store(spark, str(tmp_path / f"store{parents}"))
        store.import_log(str(tmp_path / "log.xes"), parents=parents)
        assert sorted(r[0] for r in rows(store, "select [e:c:whole]")) == ["S+0.5+L", "S+3.0+L", "a+own+3.0+L", "true+L"]
        assert sorted((r[-1]) for r in rows(store, "select count(e:step) group by [e:c:Whole]")) == [1, 1, 1, 1]
        with pytest.raises(Exception, match="not found"):
            store.query("select count(e:step) group by [e:c:Nothing]")
        assert store.query("select count(e:step) where t:ship = 'none' group by [e:c:Nothing]").count() == 0
