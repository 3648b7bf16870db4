from seriesforge.api import Api

from .load import storage


def test_endpoints(spark):
    api = Api(timeout_ms=0, storage=storage(spark, 'm{a="1"} 1 2 3\nm{a="2"} 4 5 6\nn NaN', external={"e": "x"}))
    status, out = api.handle("/api/v1/query", query="m", time="600")
    assert status == 200 and out["data"]["resultType"] == "vector"
    assert out["data"]["result"] == [{"metric": {"__name__": "m", "a": a, "e": "x"}, "value": [600.0, v]} for a, v in (("1", "3"), ("2", "6"))]
    _, out = api.handle("/api/v1/query_range", query="sum(m)", start="0", end="600", step="5m")
    assert out["data"] == {"resultType": "matrix", "result": [{"metric": {}, "values": [[0.0, "5"], [300.0, "7"], [600.0, "9"]]}]}
    assert api.handle("/api/v1/query", query="1 / 0", time="0")[1]["data"] == {"resultType": "scalar", "result": [0.0, "+Inf"]}
    assert api.handle("/api/v1/query", query="n", time="1970-01-01T00:00:00Z")[1]["data"]["result"][0]["value"][1] == "NaN"
    assert api.handle("/api/v1/labels")[1]["data"] == ["__name__", "a", "e"]
    assert api.handle("/api/v1/label/a/values", **{"match[]": 'm{a!="2"}'})[1]["data"] == ["1"]
    assert len(api.handle("/api/v1/series", **{"match[]": ["m", "n"]})[1]["data"]) == 3
    out = api.handle("/api/v1/series", **{"match[]": ["m", "n"], "limit": "1"})[1]
    assert len(out["data"]) == 1 and out["warnings"]
    assert api.info() == {"mint": 0, "maxt": 600_000, "labels": {"e": "x"}}


def test_errors(spark):
    api = Api(storage(spark, 'm{a="1"} 1'), max_samples=1, timeout_ms=0)
    for path, params, want in (
        ("/query", {"query": "sum("}, 400), ("/query", {"query": "m", "time": "x"}, 400), ("/series", {}, 400), ("/nowhere", {}, 404), ("/label/a-b/values", {}, 400),
        ("/query_range", {"query": "m", "start": "5", "end": "1", "step": "1"}, 400), ("/query_range", {"query": "m", "start": "0", "end": "1", "step": "0"}, 400),
        ("/query_range", {"query": "vector(1)", "start": "0", "end": "9", "step": "1"}, 400), ("/query", {"query": "m", "time": "2024-01-01T00:00:00"}, 400),
    ):
        status, out = api.handle(f"/api/v1{path}", **params)
        assert status == want and out["status"] == "error", (path, out)


def test_timeout_and_execution_errors(spark):
    api = Api(storage(spark, 'm{a="1"} 1\nm{a="2"} 1\nn{a="1"} 1'))
    status, out = api.handle("/api/v1/query", query="m", time="0", timeout="1ms")
    assert (status, out["errorType"]) in ((408, "timeout"), (500, "internal"))
    status, out = api.handle("/api/v1/query", query="n / on () m", time="0", timeout="10m")
    assert status in (400, 408, 500) and out["status"] == "error"
