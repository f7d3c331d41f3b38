"""A SPARQL endpoint over HTTP: GET or POST of queries, POST of updates.

The store is a log of changes. Queries that are remembered are live: an update is handed to each of them, and waits there until the
query is asked again, so an update costs no more than its own rows and a query asked again no more than what has changed since.

    python -m quadrille.endpoint --port 8080 --path sparql --cache-size 16 --from-file data.ttl
"""

from __future__ import annotations

import argparse
import json
import logging
from collections import OrderedDict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.graph import Graph
from quadrille.plans.parser import QueryError, parse
from quadrille.sources import ntriples, results, turtle
from quadrille.streaming.incremental import LiveQuery, consolidated
from quadrille.storage import written
from quadrille.terms import struct_of

#: Updates that are kept apart before they are merged into the store.
LOG = 32


class Endpoint:
    """Queries and updates on a store of quads; `keep` queries are remembered, the least used ones go first."""

    def __init__(self, quads: DataFrame, keep: int = 16):
        self.spark, self.keep, self.lock = quads.sparkSession, keep, Lock()
        self.base = written(quads.select("s", "p", "o", "g").distinct(), "endpoint-store")
        self.log: list[DataFrame] = []
        self.cache: OrderedDict[str, LiveQuery] = OrderedDict()

    @property
    def quads(self) -> DataFrame:
        out = self.base
        for c in self.log:  # in turn: each is a set's change
            out = consolidated(out.withColumn("w", F.lit(1).cast("bigint")).union(c)).where("w > 0").select("s", "p", "o", "g")
        return out

    def live(self, text: str) -> LiveQuery:
        """The query of a text, as it is remembered, or begun over the store as it is."""
        if text not in self.cache:
            q = LiveQuery(self.spark, text, deferred=True)
            q.push(self.quads.withColumn("w", F.lit(1)))
            if not self.keep:
                return q
            self.cache[text] = q
            if len(self.cache) > self.keep:
                self.cache.popitem(last=False)
        self.cache.move_to_end(text)
        return self.cache[text]

    def query(self, text: str, form: str = "json") -> str:
        with self.lock:
            q = parse(text)
            if q.ask:
                return '{"head":{},"boolean":%s}' % str(Graph.of_quads(self.quads).ask(q)).lower()
            if q.order_by or q.limit is not None or q.offset:  # an order isn't kept by counts
                rows = Graph.of_quads(self.quads).query(q)
            else:
                live = self.live(text)
                rows = live.results().select(*(struct_of(F.col(f"`{n}`")).alias(n) for n in live.names), F.explode(F.sequence(F.lit(1), F.col(live.n).cast("int"))).alias("_each")).drop("_each")
            return (results.to_xml if form == "xml" else results.to_json)(rows)

    def update(self, text: str) -> None:
        with self.lock:
            changes = results.changes(self.spark, text)
            self.log.append(written(changes, "endpoint-update"))
            for q in self.cache.values():
                q.push(self.log[-1])
            if len(self.log) > LOG:
                self.base, self.log = written(self.quads, "endpoint-store"), []


def serve(endpoint: Endpoint, port: int = 0, path: str = "/sparql") -> ThreadingHTTPServer:
    """A server, not yet running: serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, fields: dict[str, list[str]]) -> None:
            try:
                if "update" in fields:
                    endpoint.update(fields["update"][0])
                    return self.send(204, "", "text/plain")
                if "query" not in fields:
                    return self.send(400, "no query", "text/plain")
                form = "xml" if "xml" in self.headers.get("Accept", "") else "json"
                self.send(200, endpoint.query(fields["query"][0], form), f"application/sparql-results+{form}")
            except (QueryError, ValueError) as e:
                self.send(400, str(e), "text/plain")

        def send(self, status: int, body: str, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind + "; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            fields = parse_qs(at.query)
            fields.pop("update", None)
            self.answer(fields) if at.path == path else self.send(404, "", "text/plain")

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            kind = self.headers.get("Content-Type", "")
            fields = {"query": [body]} if "sparql-query" in kind else {"update": [body]} if "sparql-update" in kind else parse_qs(body)
            self.answer(fields) if urlsplit(self.path).path == path else self.send(404, "", "text/plain")

        def log_message(self, form: str, *args) -> None:
            logging.getLogger(__name__).info(form, *args)

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quadrille.endpoint", description="A SPARQL endpoint over one store of quads.")
    parser.add_argument("--path", default="sparql", help="the name of the endpoint")
    parser.add_argument("--port", type=int, default=8080)
    parser.add_argument("--cache-size", type=int, default=0, help="queries to remember; 0 (the default): none")
    parser.add_argument("--verbose", action="store_true", help="log every request")
    parser.add_argument("--from-file", help="N-Triples, N-Quads, Turtle or TriG that the store begins with")
    args = parser.parse_args(argv)
    from quadrille.session import local_session

    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    spark = local_session()
    if not args.from_file:
        quads = spark.createDataFrame([], "s string, p string, o string, g string")
    else:
        quads = (ntriples if args.from_file.endswith((".nt", ".nq")) else turtle).read(spark, args.from_file)
    server = serve(Endpoint(quads, args.cache_size), args.port, "/" + args.path.strip("/"))
    print(json.dumps({"endpoint": f"http://127.0.0.1:{server.server_port}/{args.path.strip('/')}"}), flush=True)
    server.serve_forever()


if __name__ == "__main__":
    main()
