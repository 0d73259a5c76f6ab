"""Queries over a small imported log; results are worked out from the same rows in plain Python."""

import gzip
import json
import zipfile
from collections import Counter, defaultdict
from datetime import datetime, timezone

import pytest

from loomtrace.plans.syntax import QueryError
from loomtrace.store import Conflict, Store

SAMPLES = [
    ("S-04", {"urgent": True, "site": "North"}, [
        ("Register", "2022-03-07T08:15:00.000+01:00", "Mira", {"lifecycle:transition": "start"}),
        ("Weigh", "2022-03-07T08:20:30.500+01:00", "Mira", {"lifecycle:transition": "complete", "mass": 12.5}),
        ("Assay", "2022-03-08T09:00:00.000+01:00", "Tomasz", {"mass": 11.25, "method": "titration"}),
        ("Review", "2022-03-10T16:45:00.000+01:00", "Ines", {}),
    ]),
    ("S-05", {"urgent": False, "site": "South"}, [
        ("Register", "2022-03-07T23:30:00.000+00:00", "Oskar", {"mass": 3.0}),
        ("Reject", "2022-03-08T05:30:00.000+00:00", "Ines", {"note": "Seal Broken"}),
    ]),
    ("S-06", {"urgent": True}, [
        ("Register", "2022-04-01T06:00:00.000+00:00", "Oskar", {"mass": 7.75}),
        ("Assay", "2022-04-03T06:00:00.000+00:00", "Tomasz", {}),
        ("Archive", "2022-04-05T06:00:00.000+00:00", "robot", {}),
    ]),
    ("S-08", {"urgent": False, "site": "North"}, [
        ("Register", "2022-04-02T10:05:09.007+00:00", "Mira", {}),
        ("Assay", "2022-04-02T22:05:09.000+00:00", "Oskar", {"mass": 20.0, "method": "ashing"}),
        ("Archive", "2022-12-31T23:59:59.999+00:00", "robot", {"mass": 19.0}),
    ]),
]
EVENTS = [{"name": n, "time": t, "who": w, "trace": s, **of, **more} for s, of, events in SAMPLES for n, t, w, more in events]


def xes(log="Laboratory") -> str:
    kinds = {bool: "boolean", float: "float", str: "string"}
    attribute = lambda k, v: f'<{kinds[type(v)]} key="{k}" value="{str(v).lower() if isinstance(v, bool) else v}"/>'
    out = [f'<?xml version="1.0"?><log xmlns="http://www.xes-standard.org/">{attribute("concept:name", log)}']
    for name, of, events in SAMPLES:
        out.append("<trace>" + attribute("concept:name", name) + "".join(attribute(k, v) for k, v in of.items()))
        for activity, time, who, more in events:
            out.append("<event>" + attribute("concept:name", activity) + f'<date key="time:timestamp" value="{time}"/>' + attribute("org:resource", who))
            out.append("".join(attribute(k, v) for k, v in more.items()) + "</event>")
        out.append("</trace>")
    return "".join(out) + "</log>"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("laboratory")
    (folder / "lab.xes").write_text(xes())
    s = Store(spark, str(folder / "store"))
    assert len(s.import_log(str(folder / "lab.xes"))) == 1
    return s


def at(e) -> datetime:
    return datetime.fromisoformat(e["time"])


def days(e, since) -> float:
    return (at(e) - datetime.fromisoformat(since)).total_seconds() / 86400


def shown(x):
    """A number that comes from an attribute of any type is its text."""
    return None if x is None else str(x)


def pick(*names, where=lambda e: True):
    return [tuple(e.get(n) for n in names) for e in EVENTS if where(e)]


def grouped(key, where=lambda e: True):
    out = defaultdict(list)
    for e in EVENTS:
        if where(e):
            out[e.get(key)].append(e)
    return out


def masses(events):
    return [e["mass"] for e in events if "mass" in e]


def half_up(x):
    return int((x + 0.5) // 1)


HEAVY = lambda e: e.get("mass", 0) > 10
CASES = {
    "select e:name, t:name where t:name = 'S-05'": pick("name", "trace", where=lambda e: e["trace"] == "S-05"),
    "select e:name where t:site = 'North' and e:resource != 'Mira'": pick("name", where=lambda e: e.get("site") == "North" and e["who"] != "Mira"),
    "select e:name where ([e:mass] > 10 and e:name like 'A%') or e:name in ('Reject', 'Weigh')": pick("name", where=lambda e: (HEAVY(e) and e["name"][0] == "A") or e["name"] in ("Reject", "Weigh")),
    "select t:name where ([e:mass] > 10 and e:name like 'A%') or e:name in ('Reject')": [("S-04",), ("S-05",), ("S-08",)],
    "select e:name where [e:note] is not null": pick("name", where=lambda e: "note" in e),
    "select e:name where [e:method] is null and not (e:resource in ('Mira', 'robot'))": pick("name", where=lambda e: "method" not in e and e["who"] not in ("Mira", "robot")),
    "select lower([e:note]), upper(e:name) where [e:note] is not null": [("seal broken", "REJECT")],
    "select [e:mass], round([e:mass] * 1.9) where [e:mass] is not null": [(shown(e["mass"]), half_up(e["mass"] * 1.9)) for e in EVENTS if "mass" in e],
    "select round(([e:mass] - 2) / 4 + 0.5) where [e:mass] is not null": [(half_up((e["mass"] - 2) / 4 + 0.5),) for e in EVENTS if "mass" in e],
    "select year(e:timestamp), month(e:timestamp), day(e:timestamp), hour(e:timestamp), dayofweek(e:timestamp)": [(at(e).year, at(e).month, at(e).day, at(e).hour, at(e).isoweekday() % 7 + 1) for e in EVENTS],
    "select minute(e:timestamp), second(e:timestamp), millisecond(e:timestamp), quarter(e:timestamp)": [(at(e).minute, at(e).second, at(e).microsecond // 1000, (at(e).month + 2) // 3) for e in EVENTS],
    "select e:timestamp - '2022-03-07T00:00:00.000+00:00' where e:name = 'Assay'": [(days(e, "2022-03-07T00:00:00+00:00"),) for e in EVENTS if e["name"] == "Assay"],
    "select round((e:timestamp - '2022-03-07T01:00:00.000+01:00') * 24) where t:name = 'S-05'": [(24,), (30,)],
    "select e:name, count(e:name), min([e:mass]), max([e:mass]) group by e:name": [(n, len(x), shown(min(masses(x), default=None)), shown(max(masses(x), default=None)), len(x)) for n, x in grouped("name").items()],
    "select e:name, sum([e:mass]), avg([e:mass]) group by e:name": [(n, sum(m) if (m := masses(x)) else None, sum(m) / len(m) if m else None, len(x)) for n, x in grouped("name").items()],
    "select t:name, sum([e:mass]), count(e:name) group by t:name": [(n, sum(masses(x)), len(x), len(x)) for n, x in grouped("trace").items()],
    "select e:resource, count(e:name) where t:urgent = true group by e:resource": [(n, len(x), len(x)) for n, x in grouped("who", lambda e: e["urgent"]).items()],
    "select count(e:name), round(avg([e:mass]))": [(12, half_up(sum(masses(EVENTS)) / len(masses(EVENTS))), 12)],
    "select sum([e:mass*4])": [(4 * sum(masses(EVENTS)), 12)],
    "select count(l:name), count(t:name), count(e:name)": [(1, 4, 12, 12)],
    "select count(t:name)": [(4, 4)],
    "select count(l:name)": [(1, 1)],
    "select t:name where l:name = 'Laboratory' and t:name like 'S-0%' and [e:mass] < 8": [("S-05",), ("S-06",)],
    "select e:name where l:name = 'Laboratory' and t:name like 'S-0%' and [e:mass] < 8": pick("name", where=lambda e: e.get("mass", 9) < 8),
    "select e:name where e:name matches '^(Re|We).*[^r]$'": pick("name", where=lambda e: e["name"] in ("Review", "Reject", "Weigh")),
    "select t:name where [t:urgent] = false": [("S-05",), ("S-08",)],
    "select t:name where t:site is null": [("S-06",)],
    "select t:name where [e:c:Event Name] = 'Archive'": [("S-06",), ("S-08",)],
    "select [e:c:Event Name] where t:name = 'S-04' and e:resource = 'Mira'": [("Register+start",), ("Weigh+complete",)],
    "select [e:mass] where [e:mass] in (3, 7.75, 8)": [("3.0",), ("7.75",)],
    "select e:name, t:name limit e:1": [("Register", s) for s, *_ in SAMPLES],
    "select e:name, t:name limit e:1 offset t:2, e:1": [("Assay", "S-06"), ("Assay", "S-08")],
    "select e:name where e:name = null": [],
    "where 1=2": [],
    "select e:name where e:timestamp < '2022-03-07T08:15:00+01:00'": [],
    "select e:name where e:timestamp <= '2022-03-07T02:15:00-05:00'": [("Register",)],
    "select date(e:timestamp), time(e:timestamp) where e:name = 'Review'": [("2022-03-10T00:00+01:00", "1970-01-01T16:45+01:00")],
    "select date(e:timestamp), time(e:timestamp) where e:name = 'Reject'": [("2022-03-08T00:00Z", "1970-01-01T05:30Z")],
}


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("text", CASES)
def test_rows(store, text):
    got, want = ordered(tuple(r) for r in store.query(text).collect()), ordered(CASES[text])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == tuple(pytest.approx(x) if isinstance(x, float) else x for x in w)


def test_orders(store):
    rows = lambda q: [tuple(r) for r in store.query(q).collect()]
    by_time = sorted(EVENTS, key=lambda e: at(e).astimezone(timezone.utc))
    assert rows("select e:name, e:timestamp order by e:timestamp limit 5 offset 2") == [(e["name"], e["time"]) for e in by_time[2:7]]
    heavy = sorted(masses(EVENTS), reverse=True)
    assert rows("select [e:mass] order by [e:mass] desc limit 9") == [(shown(m),) for m in heavy] + [(None,)] * (9 - len(heavy))
    assert [r[0] for r in rows("select e:name, sum([e:mass]) group by e:name order by sum([e:mass]) desc limit 2")] == ["Assay", "Archive"]
    assert [r[:2] for r in rows("select t:name, e:name order by t:name desc, e:timestamp limit t:2, e:2")] == [("S-08", "Register"), ("S-08", "Assay"), ("S-06", "Register"), ("S-06", "Assay")]
    assert len(rows("order by avg([e:mass])")) == 4
    spans = dict(r[:2] for r in rows("select t:name, (max(e:timestamp) - min(e:timestamp)) group by t:name"))
    assert spans["S-06"] == 4 and spans["S-05"] == 0.25


def test_variants(store):
    paths = Counter(tuple(n for n, *_ in events) for *_, events in SAMPLES)
    got = store.query("select count(t:name), sum([e:mass]) group by ^e:name order by count(t:name) desc").collect()
    assert {tuple(r[0]): r[1] for r in got} == paths and tuple(got[0][0]) == ("Register", "Assay", "Archive") and got[0][2] == 7.75 + 39
    got = store.query("select e:name group by ^e:name order by name").collect()
    assert sorted(tuple(r["variant"]) for r in got) == sorted(tuple(sorted(p)) for p in paths)
    assert sorted(r["t:name"] for r in store.query("select count(e:name) group by t:name, ^e:name").collect()) == [s for s, *_ in SAMPLES]


def test_group_payloads(store):
    variant = json.loads(store.execute("select count(t:name) group by ^e:name order by count(t:name) desc"))[0]
    assert [e["e:concept:name"] for e in variant["events"]] == variant["variant"] and variant["events"][0]["t:concept:name"] == "S-06" and variant["count"] == 2
    group = next(g for g in json.loads(store.execute("select e:name, sum([e:mass]) group by e:name")) if g["e:name"] == "Reject")
    assert len(group["events"]) == 1 and group["events"][0]["e:note"] == "Seal Broken" and group["count"] == 1
    assert json.loads(store.execute("select count(e:name) where e:name = 'Lost'"))[0]["count"] == 0
    (total,) = json.loads(store.execute("select l:*, count(e:name)"))
    assert total["l:concept:name"] == "Laboratory" and total["count(e:name)"] == 12


def test_shell(store, capsys):
    from loomtrace.__main__ import main

    main([store.path, "query", "select count(e:name)"])
    assert json.loads(capsys.readouterr().out)[0]["count(e:name)"] == 12
    main([store.path, "vacuum"])
    assert json.loads(capsys.readouterr().out) == 0


def test_select_all_and_json(store):
    rows = json.loads(store.execute("select e:* where e:name = 'Reject'"))
    assert rows[0]["e:note"] == "Seal Broken" and not any(k.startswith("t:") for k in rows[0])
    rows = json.loads(store.execute("where e:name = 'Reject'"))
    assert rows[0]["t:concept:name"] == "S-05" and rows[0]["l:concept:name"] == "Laboratory" and {"_id", "traceId", "logId"} <= set(rows[0])


@pytest.mark.parametrize("text", ["order by c:unheard", "group by [^c:unheard of]", "select e:name order by [e:weight]"])
def test_unknown_names(store, text):
    with pytest.raises(QueryError, match="not found"):
        store.query(text)


@pytest.mark.parametrize("text", ["where false", "select 8-3", "selct e:name", "where e:mass >", "select e:name limit 2.5", "Select e:name", "delete event limit t:1"])
def test_refused(store, text):
    with pytest.raises(QueryError):
        store.execute(text)


def files(store) -> set[str]:
    import pathlib

    return {str(p.relative_to(store.path)) for p in pathlib.Path(store.path, "data").rglob("*.parquet")}


def test_formats_cascades_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "two.zip", "w") as z:
        z.writestr("first.xes", xes("First"))
        z.writestr("second.xes", xes("Second"))
        z.writestr("readme.txt", "no log")
    with gzip.open(tmp_path / "in" / "third.xes.gz", "wt") as f:
        f.write(xes("Third"))
    s = Store(spark, str(tmp_path / "store"))
    ids = s.import_log(str(tmp_path / "in"))
    assert len(ids) == 3 and s.table("events").count() == 36
    assert s.query("select t:name limit l:2, t:1").count() == 2

    before = files(s)
    (tmp_path / "more.xes").write_text(xes("Fourth"))
    (fourth,) = s.import_log(str(tmp_path / "more.xes"))  # an import writes the files of its log, and touches no other
    new = files(s) - before
    assert before <= files(s) and len(new) == 3 and all(f"log_id={fourth}" in f for f in new)
    assert [r["name"] for r in s.table("logs").orderBy("log_seq").collect()] == ["Third", "First", "Second", "Fourth"]

    before = files(s)
    assert json.loads(s.execute("delete event where e:name = 'Reject' and l:name = 'Second'")) == [{"deleted": 1, "status": "success"}]
    new = files(s) - before  # a delete writes what it changes of the logs that it changes
    assert len(new) == 1 and "data/events/" in new.pop()
    assert s.delete("delete trace where t:name = 'S-04' and l:name = 'Second'") == {"deleted": 5, "status": "success"}
    assert s.delete("delete where t:name = 'S-05' and l:name = 'First'") == {"deleted": 2, "status": "success"}  # events, where no scope is named
    assert s.delete("delete event order by e:timestamp desc limit 4") == {"deleted": 4, "status": "success"}
    before = files(s)
    assert s.delete("delete log where l:name = 'Third'")["status"] == "success"
    assert s.delete("delete log where l:name = 'Third'") == {"deleted": 0} and files(s) == before
    assert sorted(r[0] for r in s.query("select l:name").collect()) == ["First", "Fourth", "Second"]

    rows = lambda: sorted(map(str, s.query("select l:name, t:name, e:name, e:timestamp").collect()))
    kept = rows()
    assert s.vacuum() == 0 and s.vacuum(hours=-1) > 0
    assert rows() == kept and len(files(s)) == 3 * 3  # a file of each table for each log
    with pytest.raises(Exception):
        s.import_log(str(tmp_path / "missing.xes"))
    s.delete_all()
    assert s.table("logs").count() == 0


def test_parents_on_events(spark, tmp_path):
    """Imports that copy parents' attributes to events: the same rows without a join, predicates that reach the scan."""
    (tmp_path / "lab.xes").write_text(xes())
    s = Store(spark, str(tmp_path / "store"))
    s.import_log(str(tmp_path / "lab.xes"), parents=True)
    plan = lambda q: s.query(q)._jdf.queryExecution().executedPlan().toString()
    for text in ("select e:name, t:name where t:name = 'S-05'", "select e:name where t:site = 'North' and e:resource != 'Mira'", "select e:name where l:name = 'Laboratory' and t:name like 'S-0%' and [e:mass] < 8"):
        assert ordered(tuple(r) for r in s.query(text).collect()) == ordered(CASES[text])
        assert "Join" not in plan(text)
    assert "EqualTo(trace_concept,S-05)" in plan("select e:name where t:name = 'S-05'")
    assert s.delete("delete event where t:name = 'S-04' and e:name = 'Weigh'")["deleted"] == 1
    assert s.query("select e:name where t:name = 'S-04'").count() == 3 and "Join" not in plan("select e:name where t:name = 'S-04'")
    s.import_log(str(tmp_path / "lab.xes"))  # not all logs have them now: queries join again
    assert s.query("select e:name where t:name = 'S-04'").count() == 3 + 4 and "Join" in plan("select e:name where t:name = 'S-04'")


def test_two_writers(spark, tmp_path, monkeypatch):
    for name in ("A", "B", "C"):
        (tmp_path / f"{name}.xes").write_text(xes(name))
    s, other = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    s.import_log(str(tmp_path / "A.xes"))
    commit = Store._commit
    late = []

    def delayed(self, *args):  # the other writer's change comes before this one is put in place
        if self is s and late:
            late.pop()()
        commit(self, *args)

    monkeypatch.setattr(Store, "_commit", delayed)
    late.append(lambda: other.import_log(str(tmp_path / "B.xes")))
    s.import_log(str(tmp_path / "C.xes"))
    assert sorted(r[0] for r in s.query("select l:name").collect()) == ["A", "B", "C"]
    late.append(lambda: other.delete("delete event where l:name = 'B' and e:name = 'Assay'"))
    assert s.delete("delete event where l:name = 'C' and e:name = 'Assay'")["deleted"] == 3
    assert dict((r[0], r[1]) for r in s.query("select l:name, count(e:name) group by l:name").collect()) == {"A": 12, "B": 9, "C": 9}
    late.append(lambda: other.delete("delete trace where l:name = 'A' and t:name = 'S-04'"))
    with pytest.raises(Conflict, match="another writer"):
        s.delete("delete event where l:name = 'A' and e:name = 'Assay'")
    assert s.query("select e:name where l:name = 'A'").count() == 8
    state = s._state()
    assert not s._publish(state)  # a version is put in place once
