"""LogsQL over a few entries whose answers can be seen by eye."""

import json

import pytest

from tellurion.errors import QueryError, UnsupportedError
from tellurion.logs import Logs

NOW = 1_700_000_100_000_000
BASE = 1_700_000_000_000_000
ENTRIES = [
    (BASE + 0, 0, "info", "GET /api/users took 12ms", {"host": "web-1", "status": 200, "tags": ["a", "b"], "ip": "10.0.0.5", "http": {"path": "/api/users", "size": 10}}),
    (BASE + 1_000_000, 1, "error", "failed to open file foo_bar", {"host": "web-2", "status": 500, "ip": "10.0.1.9", "code": "500"}),
    (BASE + 2_000_000, 2, "info", "GET /health took 3ms", {"host": "web-1", "status": 200, "empty": "", "none": None}),
    (BASE + 3_000_000, 3, "warning", "Disk usage 91% on sda", {"host": "db-1", "used": 91.5, "ok": False}),
    (BASE + 86_400_000_000, 4, "error", "failed: user=alice reason=\"no access\"", {"host": "web-2", "status": 403}),
]


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(a, b, c, d, json.dumps(e)) for a, b, c, d, e in ENTRIES]
    return Logs(spark.createDataFrame(rows, "ts long, seq long, level string, message string, metadata string"))


FILTERS = {
    "*": {0, 1, 2, 3, 4}, "failed": {1, 4}, "fail": set(), "fail*": {1, 4}, "foo": set(), "foo_bar": {1}, '"open file"': {1}, '"open fi"*': {1}, "*pen*": {1}, "error": set(), "level:error": {1, 4},
    "level:error -alice": {1}, "get": set(), "i(get)": {0, 2}, "i(GE*)": {0, 2}, '~"took [0-9]+ms"': {0, 2}, "host:web-1": {0, 2}, 'host:="web-1"': {0, 2}, 'host:="web"*': {0, 1, 2, 4}, "status:>=403": {1, 4},
    "status:range(200, 500)": {4}, "status:range[200, 500]": {0, 1, 2, 4}, "code:>1": set(), "status:in(200, 403)": {0, 2, 4}, 'empty:""': {0, 1, 2, 3, 4}, "none:*": set(), "ok:*": {3}, "status:*": {0, 1, 2, 4}, "code:value_type(string)": {1},
    "status:value_type(uint64)": {0, 1, 2, 4}, "used:value_type(float64)": {3}, "ok:value_type(bool)": {3}, "none:value_type(null)": {2}, "tags:json_array_contains_any(b, z)": {0}, "ip:ipv4_range(10.0.0.0/24)": {0}, "ip:ipv4_range(10.0.0.9, 10.0.1.9)": {1},
    "host:string_range(db, e)": {3}, "host:len_range(4, 4)": {3}, "http.path:*": {0}, "_msg:contains_all(failed, open)": {1}, "_msg:contains_any(open, disk)": {1}, "_msg:seq(failed, file)": {1}, '_msg:pattern_match("took <N>ms")': {0, 2},
    'h*:="web-1"': {0, 2}, "*:db": {3}, "error or level:warning": {3}, "failed (open or alice)": {1, 4}, "!level:info !level:error": {3}, "_time:>=2023-11-15": {4}, "_time:[2023-11-14T22:13:21Z, 2023-11-14T22:13:22Z]": {1, 2}, "_time:[2023-11-14T22:13:21Z, 2023-11-14T22:13:22Z)": {1},
    "_time:2h": set(ENTRIES[i][1] for i in range(4)), "_time:day_range[22:00, 22:13]": set(), "_time:day_range[22:13, 23:00]": {0, 1, 2, 3, 4}, "_time:week_range[Tue, Tue]": {0, 1, 2, 3}, "status:eq_field(code)": {1, 3}, "status:in(_time:<2023-11-15 level:error | fields status)": {1}, "code:=500": set(), 'code:="500"': {1},
}


@pytest.mark.parametrize("query", FILTERS)
def test_filters(logs, query):
    found = {r["seq"] for r in logs.filter(query, NOW).select("seq").collect()}
    assert found == FILTERS[query], query


def rows(logs, query, *fields):
    return [tuple(r) for r in logs.query(query, NOW, *fields).collect()]


PIPES = [
    ("* | limit 2", ("_msg",), [(ENTRIES[0][3],), (ENTRIES[1][3],)]),
    ("* | sort by (_time desc) | offset 3", ("level",), [("error",), ("info",)]),
    ("* | sort by (host, status desc) | fields host, status | limit 3", ("host", "status"), [("db-1", ""), ("web-1", "200"), ("web-1", "200")]),
    ("* | stats by (level) count() n, sum(status) s, avg(status) a, max(host) h", ("level", "n", "s", "a", "h"), [("error", "2", "903", "451.5", "web-2"), ("info", "2", "400", "200", "web-1"), ("warning", "1", "", "", "db-1")]),
    ("* | count() as n", ("n",), [("5",)]),
    ("* | stats count_uniq(host) u, count(status) c, count_empty(status) e, uniq_values(level) l, sum_len(level) b", ("u", "c", "e", "l", "b"), [("3", "4", "1", '["error","info","warning"]', "25")]),
    ("* | stats median(status) m, quantile(0.9, status) q, min(status) lo, field_max(status, host) h, any(code) c", ("m", "q", "lo", "h", "c"), [("403", "500", "200", "web-2", "500")]),
    ("_time:2h | stats rate() r", ("r",), None),
    ("* | top 2 by (host) hits as n rank", ("host", "n", "rank"), [("web-1", "2", "1"), ("web-2", "2", "2")]),
    ("* | uniq by (level) hits", ("level", "hits"), [("error", "2"), ("info", "2"), ("warning", "1")]),
    ("* | field_values level", ("level", "hits"), [("error", "2"), ("info", "2"), ("warning", "1")]),
    ("* | first 1 by (_time) partition by (level) | fields level, _msg", ("level", "_msg"), [("error", ENTRIES[1][3]), ("info", ENTRIES[0][3]), ("warning", ENTRIES[3][3])]),
    ("* | last 1", ("_msg",), [(ENTRIES[4][3],)]),
    ("level:error | copy host as h | rename status as code | delete ip", ("h", "host", "code", "status", "ip"), [("web-2", "web-2", "500", "", ""), ("web-2", "web-2", "403", "", "")]),
    ('level:error | format "<uc:host>/<status>" as k', ("k",), [("WEB-2/500",), ("WEB-2/403",)]),
    ("level:error | math (status + 1) * 2 as x, round(status / 7) as y", ("x", "y"), [("1002", "71"), ("808", "58")]),
    ("level:info | len(_msg) as n | fields n", ("n",), [("24",), ("20",)]),
    ('level:info | extract "took <n>ms" | fields n', ("n",), [("12",), ("3",)]),
    ('level:info | extract_regexp "took (?P<n>[0-9]+)(?P<unit>[a-z]+)"', ("n", "unit"), [("12", "ms"), ("3", "ms")]),
    ('level:info | replace ("took", "in") | fields _msg', ("_msg",), [("GET /api/users in 12ms",), ("GET /health in 3ms",)]),
    ('level:info | replace_regexp ("[0-9]+(ms)", "N$1") | fields _msg', ("_msg",), [("GET /api/users took Nms",), ("GET /health took Nms",)]),
    ('level:info | replace_regexp ("[a-z]", "_") limit 2', ("_msg",), [("GET /__i/users took 12ms",), ("GET /__alth took 3ms",)]),
    ("level:warning | collapse_nums", ("_msg",), [("Disk usage <N>% on sda",)]),
    ('seq_missing:"" | limit 1 | split " " as parts', ("parts",), [('["GET","/api/users","took","12ms"]',)]),
    ("* | limit 1 | json_array_len(tags) as n | unroll by (tags)", ("n", "tags"), [("2", "a"), ("2", "b")]),
    ('* | limit 1 | json_array_concat "+" from tags as t', ("t",), [("a+b",)]),
    ("alice | unpack_logfmt", ("user", "reason"), [("alice", "no access")]),
    ("alice | unpack_words as w drop_duplicates", ("w",), [('["failed","user","alice","reason","no","access"]',)]),
    ('level:warning | format "{\\"x\\":{\\"y\\":1},\\"z\\":\\"q\\"}" as j | unpack_json from j result_prefix p_', ("p_x.y", "p_z"), [("1", "q")]),
    ("level:warning | pack_json fields (host, used) as j", ("j",), [('{"host":"db-1","used":91.5}',)]),
    ("level:warning | pack_logfmt fields (host, _msg) as j", ("j",), [('_msg="Disk usage 91% on sda" host=db-1',)]),
    ('level:warning | format "1 2024-01-01T00:00:00Z box app 77 ID1 [e k=\\"v\\"] hello" as m | unpack_syslog from m', ("hostname", "e.k", "message", "level"), [("box", "v", "hello", "warning")]),
    ("* | coalesce (code, status) as c | fields c", ("c",), [("200",), ("500",), ("200",), ("",), ("403",)]),
    ("* | running_stats by (host) count() n, sum(status) s | fields host, n, s", ("host", "n", "s"), [("db-1", "1", "0"), ("web-1", "1", "200"), ("web-1", "2", "400"), ("web-2", "1", "500"), ("web-2", "2", "903")]),
    ("level:error | total_stats sum(status) s | fields s", ("s",), [("903",), ("903",)]),
    ("level:error | join by (host) (level:info or level:error | stats by (host) count() n) | fields host, n", ("host", "n"), [("web-2", "2"), ("web-2", "2")]),
    ("level:warning | union (alice) | fields _msg", ("_msg",), [(ENTRIES[3][3],), (ENTRIES[4][3],)]),
    ("level:warning | time_add 1h | fields _time", ("_time",), [("2023-11-14T23:13:23Z",)]),
    ("* | generate_sequence 3", ("_msg",), [("0",), ("1",), ("2",)]),
    ("level:warning | set_stream_fields host", ("_stream",), [('{host="db-1"}',)]),
    ("* | query_stats", ("rows",), [("5",)]),
    ("level:warning | drop_empty_fields | field_names", ("name", "hits"), [("_msg", "1"), ("_time", "1"), ("host", "1"), ("level", "1"), ("ok", "1"), ("used", "1")]),
    ("level:error | facets 1", ("field_name", "field_value", "hits"), None),
    ("* | sample 1 | count() n", ("n",), [("5",)]),
    ("level:warning | hash(host) as h", ("h",), None),
    ("level:warning | decolorize | fields _msg", ("_msg",), [(ENTRIES[3][3],)]),
    ("* | stats histogram(status) h, json_values(host) limit 1 j, row_min(status, host) r, stddev(status) d", ("h", "j", "r"), None),
    ("* | filter status:>300 | fields status", ("status",), [("500",), ("403",)]),
]


@pytest.mark.parametrize("query,fields,want", PIPES, ids=[q for q, _, _ in PIPES])
def test_pipes(logs, query, fields, want):
    found = rows(logs, query, *fields)
    if want is None or want == [(None,)]:
        assert found
        return
    assert found == want


@pytest.mark.parametrize("query", ['{app="x"}', "_stream_id:5", "* | stream_context before 1", "* | block_stats", "* | blocks_count", "options(concurrency=2) *", "options(allow_partial_response=true) *", 'x:~"(?=a)"'])
def test_what_is_rejected(logs, query):
    with pytest.raises(UnsupportedError):
        logs.query(query, NOW)


@pytest.mark.parametrize("query", ["", "(", "a | nonsense", "_time:[2024, 2023]", "_time:xyz", "status:>abc", "* | stats foo(a)", "a)"])
def test_what_is_malformed(logs, query):
    with pytest.raises(QueryError):
        logs.query(query, NOW)


def test_options(logs):
    assert rows(logs, 'options(global_filter=(level:error)) * | count() n', "n") == [("2",)]
    assert rows(logs, "options(time_offset=1h) level:warning | fields _time", "_time") == [("2023-11-14T23:13:23Z",)]


def reads(logs, query):
    """How often the plan parses a row's JSON, and how often it looks a path up."""
    plan = logs.query(query, NOW, ordered=False)._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("parseJson"), plan.count("get_json_object(metadata")


def test_uniq_reads_its_fields_once(logs):
    assert reads(logs, "* | uniq by (status, host) hits") == (1, 2)
    assert reads(logs, "* | top 2 by (status)") == (1, 1)
    assert [json.loads(r["row"]) for r in logs.query("* | top 2 by (status)", NOW).collect()] == [{"status": 200, "hits": 2}, {"status": 403, "hits": 1}]


def test_filters_read_their_fields_once(logs):
    assert reads(logs, "status:<400 -host:db | uniq by (status) hits") == (1, 2)
    assert reads(logs, "* | filter status:>=400 | count() n") == (1, 1)
    assert [json.loads(r["row"]) for r in logs.query("status:<403 -host:db | uniq by (status) hits", NOW).collect()] == [{"status": 200, "hits": 2}]
