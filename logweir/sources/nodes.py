"""Tables that a cluster's nodes answer with, as a data source with a partition for each node.

Every partition sends the table's command to its node and reads the JSON answer.  Comparisons of node_id
with constants are taken before any node is contacted.  A node that can't be reached or whose answer can't be
read gives one row that says why; the others are not affected.
"""

from __future__ import annotations

import base64
import json
import re
import socket
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FORMAT = "logweir_nodes"
SCHEMA = "node_id int, address string, row int, cells map<string,string>, error string, latency_ms double"
MOST_BYTES = 1 << 28


def column_name(header: str) -> str:
    """As ``scalars.column_name``."""
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")


def parsed(answer: str) -> list[dict[str, str | None]]:
    """Rows of ``{"headers": [...], "rows": [[...]]}``; anything else is refused as a whole."""
    table = json.loads(answer)
    names = [column_name(h) for h in table["headers"]]
    for row in table["rows"]:
        if len(row) != len(names):
            raise ValueError("a row's length differs from the header's")
    return [dict(zip(names, row, strict=True)) for row in table["rows"]]


def ask(address: str, command: str, timeout: float) -> str:
    """The answer of a node: over a socket (host:port), from a file that holds it (file:path), or from the address itself (data:base64)."""
    if address.startswith("data:"):
        return base64.b64decode(address.removeprefix("data:")).decode()
    if address.startswith("file:"):
        with open(address.removeprefix("file:").removeprefix("//"), encoding="utf-8") as f:
            return f.read()
    host, _, port = address.rpartition(":")
    with socket.create_connection((host, int(port)), timeout) as s:
        s.settimeout(timeout)
        s.sendall(command.encode() + b"\n")
        s.shutdown(socket.SHUT_WR)
        parts, size = [], 0
        while part := s.recv(1 << 16):
            parts.append(part)
            size += len(part)
            if size > MOST_BYTES:
                raise ValueError("an answer of over 256 MB")
    return re.sub(r"\r?\nEND\r?\n?$", "", b"".join(parts).decode("utf-8"))


class Node(InputPartition):
    def __init__(self, node_id: int, address: str):
        super().__init__(node_id)
        self.node_id, self.address = node_id, address


TESTS = {
    EqualTo: lambda n, v: n == v, In: lambda n, v: n in v, GreaterThan: lambda n, v: n > v,
    GreaterThanOrEqual: lambda n, v: n >= v, LessThan: lambda n, v: n < v, LessThanOrEqual: lambda n, v: n <= v,
}


class NodeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.nodes = [(int(i), a) for i, a in json.loads(options["nodes"])]
        self.command, self.timeout = options.get("command", ""), float(options.get("timeout", "5"))

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            test = TESTS.get(type(f))
            if test and f.attribute == ("node_id",) and f.value is not None:
                self.nodes = [n for n in self.nodes if test(n[0], f.value)]
            else:
                yield f

    def partitions(self) -> list[Node]:
        return [Node(*n) for n in self.nodes] or [Node(-1, "")]

    def read(self, node: Node) -> Iterator[tuple]:
        if not node.address:  # no node is left
            return
        began = time.monotonic()
        try:
            rows = parsed(ask(node.address, self.command, self.timeout))
        except Exception as e:  # whatever is wrong with a node concerns that node alone
            yield node.node_id, node.address, None, None, f"{type(e).__name__}: {e}"[:500], (time.monotonic() - began) * 1000
            return
        took = (time.monotonic() - began) * 1000
        for k, cells in enumerate(rows):
            yield node.node_id, node.address, k, {n: None if v is None else str(v) for n, v in cells.items()}, None, took


class NodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NodeReader:
        return NodeReader(self.options)


def node_answers(spark: SparkSession, nodes: dict[int, str], command: str, timeout: float = 5.0) -> DataFrame:
    """(node_id, address, row, cells, error, latency_ms): what all nodes answer to a command, or why they don't.

    Filters on node_id are pushed to the source, for which the session's ``spark.sql.python.filterPushdown.enabled`` is set.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NodeSource)
    return spark.read.format(FORMAT).options(nodes=json.dumps(sorted(nodes.items())), command=command, timeout=str(timeout)).load()


def holding(answers: dict[int, str]) -> dict[int, str]:
    """Addresses that hold these answers themselves, for tables that come from elsewhere than a live cluster."""
    return {n: "data:" + base64.b64encode(a.encode()).decode() for n, a in answers.items()}
