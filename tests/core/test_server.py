"""The service over HTTP: replies, refusals and the audit trail."""

import json
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from fslink.server import Tables, server


def test_server(spark, tmp_path):
    cases = spark.createDataFrame([("a", "HOME", "p1"), ("b", "HOME", "p2")], "case_id string, crime_type string, pii_ref string")
    links = spark.createDataFrame([("a", "b", 1, 5.0, "same_type"), ("a", "c", 2, 1.0, "cross_type")], "case_id string, partner_id string, rank int, total_bits double, pair_class string")
    clusters = spark.createDataFrame([(1, ["a", "b"], 2)], "cluster_id long, members array<string>, size int")
    pii = spark.createDataFrame([("p1", "somebody")], "pii_ref string, name string")
    http = server(spark, Tables(cases, links, clusters, pii, f"{tmp_path}/feedback", f"{tmp_path}/audit"))
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urlopen(Request(f"http://127.0.0.1:{http.server_port}{path}", data, {"X-Actor": "tester"})) as r:
                return r.status, json.load(r)
        except HTTPError as e:
            return e.code, json.load(e)

    try:
        assert call("/cases/a") == (200, {"case_id": "a", "crime_type": "HOME"})
        assert call("/cases/zz")[0] == 404 and call("/nothing")[0] == 404 and call("/cases/a/links?limit=x")[0] == 400
        assert [x["rank"] for x in call("/cases/a/links?scope=all")[1]["links"]] == [1, 2] and call("/cases/a/links?scope=cross_type")[0] == 400
        status, frame = call("/cases/a/links")
        assert status == 200 and (frame["case_id"], frame["scope"]) == ("a", "same") and [x["rank"] for x in frame["links"]] == [1] and call("/cases/a/links?limit=51")[0] == 400
        assert call("/clusters/b")[1]["members"] == ["a", "b"] and call("/clusters/c")[0] == 404
        fine = {"case_id_a": "a", "case_id_b": "b", "status": "confirmed", "reason": "seen"}
        status, row = call("/feedback", fine)
        assert status == 201 and row["pair_id"] == "a#b" and row["actor_id"] == "tester"
        assert call("/feedback", fine | {"reason": " "})[0] == 400 and call("/feedback", [1])[0] == 400
        assert call("/pii-requests", {"pii_ref": "p1"})[0] == 403
        assert call("/pii-requests", {"pii_ref": "p1", "reason": "court order"}) == (200, [{"pii_ref": "p1", "name": "somebody"}])
    finally:
        http.shutdown()
        http.server_close()
    actions = [r.action for r in spark.read.parquet(f"{tmp_path}/audit").collect()]
    assert {"pii_allow", "pii_deny", "GET /cases", "POST /feedback"} <= set(actions) and spark.read.parquet(f"{tmp_path}/feedback").count() == 1
