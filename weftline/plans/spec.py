"""Job specifications: a small graph of nodes folded into lazy DataFrames.

A spec is {"nodes": [...], "connexions": [...]}.  A node has id, type (start, db_input, map, db_output, log,
email_output) and config; a connexion has from, to, type ("data" or "flow") and, on data, the output of a
map node and the name of the input it feeds.  Only nodes that flow reaches from a start node run.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import rules_filter
from ..operators.apply import apply
from ..operators.combine import cross_join, lookup_join, project, union_by_lineage
from ..sinks.writers import log_lines, messages
from ..sources.sql import identifier, sql_source

SINKS = ("db_output", "log", "email_output")


@dataclass
class Job:
    """A built job: every reached node's DataFrames, the sinks in spec order, and the nodes left out."""

    frames: dict[str, dict[str, DataFrame]]
    sinks: list[str]
    orphans: list[str]
    counts: dict[str, Observation] = field(default_factory=dict)
    persisted: list[DataFrame] = field(default_factory=list)
    feeds: dict[str, DataFrame] = field(default_factory=dict)  # what each sink is given
    above: dict[str, list[str]] = field(default_factory=dict)  # the nodes whose rows each node gets

    def upstream(self, node: str) -> list[str]:
        """The node and all whose rows it is made of."""
        seen, todo = [], [node]
        while todo:
            name = todo.pop()
            if name not in seen:
                seen.append(name)
                todo += self.above.get(name, [])
        return seen

    def result(self, node: str, output: str | None = None) -> DataFrame:
        frames = self.frames[node]
        return frames[output] if output else next(iter(frames.values()))

    def release(self) -> None:
        for df in self.persisted:
            df.unpersist()

    def progress(self) -> list[tuple[str, int]]:
        """(node, rows) of observed nodes, once their sinks have run."""
        return [(n, o.get["rows"]) for n, o in self.counts.items()]


def validate(spec: dict) -> None:
    nodes = {n["id"]: n for n in spec.get("nodes", [])}
    if not nodes:
        raise ValueError("a job needs nodes")
    if len(nodes) != len(spec["nodes"]):
        raise ValueError("node ids repeat")
    if not any(n["type"] == "start" for n in nodes.values()):
        raise ValueError("a job needs a start node")
    for c in spec.get("connexions", []):
        if c["from"] not in nodes or c["to"] not in nodes:
            raise ValueError(f"a connexion leads to no node: {c}")
    for n in nodes.values():
        if n["type"] == "map":
            inputs = [c for c in spec.get("connexions", []) if c["type"] == "data" and c["to"] == n["id"]]
            if not n["config"].get("outputs"):
                raise ValueError(f"map {n['id']} has no output")
            if len(inputs) > 2:
                raise ValueError(f"map {n['id']} has more than two inputs")
            if len(inputs) == 2 and not n["config"].get("join"):
                raise ValueError(f"map {n['id']} has two inputs but no join")
        if n["type"] == "db_output" and n["config"].get("table"):
            identifier(n["config"]["table"])


def reachable(spec: dict) -> list[str]:
    """Ids of nodes that flow reaches, and of those that feed them data, in spec order."""
    flow, feeds = defaultdict(list), defaultdict(list)
    for c in spec.get("connexions", []):
        (flow[c["from"]] if c["type"] == "flow" else feeds[c["to"]]).append(c["to"] if c["type"] == "flow" else c["from"])
    seen = {n["id"] for n in spec["nodes"] if n["type"] == "start"}
    todo = list(seen)
    while todo:
        for other in flow[todo.pop()]:
            if other not in seen:
                seen.add(other)
                todo.append(other)
    todo = list(seen)
    while todo:
        for other in feeds[todo.pop()]:
            if other not in seen:
                seen.add(other)
                todo.append(other)
    return [n["id"] for n in spec["nodes"] if n["id"] in seen]


def map_node(inputs: dict[str, DataFrame], config: dict) -> dict[str, DataFrame]:
    """Each output of a map node over its one or two named inputs, as selections over one shared plan."""
    outputs, join = config["outputs"], config.get("join")
    names = list(inputs)
    if len(inputs) == 1:
        base = inputs[names[0]].alias(names[0])
        return {o["name"]: project(base, o["columns"]) for o in outputs}
    left, right = join.get("left", names[0]), join.get("right", names[1])
    pair, kind = (left, right), join.get("type", "left")
    if kind == "union":
        return {o["name"]: union_by_lineage(inputs[left], inputs[right], o["columns"], pair) for o in outputs}
    if kind == "cross":
        base = cross_join(inputs[left], inputs[right], pair)
    else:
        left_keys = join.get("leftKeys") or [join["leftKey"]]
        right_keys = join.get("rightKeys") or [join["rightKey"]]
        base = lookup_join(inputs[left], inputs[right], left_keys, right_keys, kind, join.get("match", "last"), join.get("orderBy"), pair)
    return {o["name"]: project(base, o["columns"], config.get("prefixJoinColumns", False)) for o in outputs}


def build(
    spark: SparkSession, spec: dict, targets: Callable[[dict], DataFrame] | None = None,
    given: dict[str, DataFrame] | None = None, observe: bool = False, persist: bool = False,
) -> Job:
    """Fold a spec into DataFrames; nothing runs.

    ``Job.feeds`` has the rows that each sink is to write.  ``targets`` gives the current state of a db_output's table (none: an empty one); ``given`` replaces the
    rows of named nodes, which is how a trigger hands its events to a job.  With ``persist`` a frame that feeds
    several nodes is computed once for all of them; ``Job.release`` gives its memory back.
    """
    validate(spec)
    nodes = {n["id"]: n for n in spec["nodes"]}
    reached = reachable(spec)
    feeds = defaultdict(list)
    for c in spec.get("connexions", []):
        if c["type"] == "data":
            feeds[c["to"]].append(c)
    job = Job({}, [n for n in reached if nodes[n]["type"] in SINKS], [n for n in nodes if n not in reached])
    busy: set[str] = set()

    def frame(node_id: str) -> dict[str, DataFrame]:
        if node_id in job.frames:
            return job.frames[node_id]
        if node_id in busy:
            raise ValueError(f"the graph has a cycle through {node_id}")
        busy.add(node_id)
        node = nodes[node_id]
        config, kind = node.get("config", {}), node["type"]
        inputs = {}
        job.above[node_id] = [c["from"] for c in feeds[node_id]]
        for i, c in enumerate(feeds[node_id]):
            outs = frame(c["from"])
            inputs[c.get("input") or chr(65 + i)] = outs[c["output"]] if c.get("output") else next(iter(outs.values()))
        if given and node_id in given:
            out = {"output": given[node_id]}
        elif kind == "start":
            out = {}
        elif kind == "db_input":
            out = {"output": sql_source(spark, config["query"], config.get("connection"))}
        elif kind == "filter":
            out = {"output": rules_filter(next(iter(inputs.values())), config.get("rules", []))}
        elif kind == "map":
            out = map_node(inputs, config)
        elif kind == "db_output":
            source = next(iter(inputs.values()))
            target = targets(config) if targets else source.limit(0)
            job.feeds[node_id] = source
            out = {"state": apply(target, source, config.get("mode", "insert"), config.get("keys"), config.get("columns"))}
        elif kind == "log":
            out = {"lines": log_lines(next(iter(inputs.values())), config.get("separator", " | "))}
        elif kind == "email_output":
            out = {"messages": messages(next(iter(inputs.values())), config["subject"], config["body"], config["to"],
                                        config.get("cc", []), config.get("bcc", []), config.get("html", False))}
        else:
            raise ValueError(f"unknown node type {kind!r}")
        if observe and out:
            name, df = next(iter(out.items()))
            job.counts[node_id] = Observation(f"node_{node_id}")
            out[name] = df.observe(job.counts[node_id], F.count(F.lit(1)).alias("rows"))
        if kind in ("log", "email_output"):
            job.feeds[node_id] = next(iter(out.values()))
        busy.discard(node_id)
        job.frames[node_id] = shared(node_id, out)
        return out

    users = Counter((c["from"], c.get("output")) for n in reached for c in feeds[n])

    def shared(node_id: str, outs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for i, (name, df) in enumerate(outs.items()):
            if persist and users[node_id, name] + (users[node_id, None] if i == 0 else 0) > 1:
                outs[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
                job.persisted.append(outs[name])
        return outs

    for node_id in reached:
        frame(node_id)
    return job
