r"""Chat formatting: reply trees.

Turns are nodes with a parent. Iterative self-joins (pointer doubling: each round joins the ancestor table with itself, so a
tree of depth d takes log2(d) rounds) give every node its root, depth and the score of its path. Leaves are ranked by that
score within their tree, the first ``top_k`` branches are chosen, and their paths are spelled out by the same ancestor tables
from the largest step down, each node of a path exactly once. Each chosen path becomes one conversation.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` for each turn. Inside roles and texts each control string (``CONTROL``) gets a
backslash after its first character, one more if it had some already; reading back takes one away. In roles, backslash and
newline are spelled ``\\`` and ``\n`` before. The loss mask is a list of (start, length) over the texts of assistant turns.

Defined results: null roles and texts count as empty; turns of one number (repeated rows too) follow each other by role and text,
null turns come first; rows whose conv_id is null form one conversation of their own. A parent that does not exist makes its
node a root; nodes on a cycle have no path. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemloom.llm.common import written
from itemloom.sources import table

START, END = "<|im_start|>", "<|im_end|>"
#: The template's own strings and those of another common one: [INST], [/INST], <s>, </s>, <<SYS>>, <</SYS>>.
CONTROL = r"(<\\*)(\|im_(?:start|end)\|>|/?s>|</?SYS>>)|(\[\\*)(/?INST\])"
_UNESCAPE = re.compile(r"(<\\*)\\(\|im_(?:start|end)\|>|/?s>|</?SYS>>)|(\[\\*)\\(/?INST\])")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$3\\$2$4")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\3\2\4", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def ancestor_steps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of (tree, node, up): up is 2**k levels above; and (tree, node, total) with the score of each node's path.

    No path is longer than its tree has nodes: what is open after so many doublings lies on a cycle or below one."""
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    first = nodes.join(known, ["tree", "parent"], "left")  # a parent that does not exist is none
    step = written(first.select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), F.col("score").alias("total")), "reply-steps")
    steps = []
    for _ in range(largest.bit_length()):
        open_ = step.filter(F.col("up").isNotNull())
        if open_.isEmpty():
            break
        steps.append(open_.select("tree", "node", "up"))
        above = step.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("total").alias("more"))
        further = open_.join(above, ["tree", "up"]).select("tree", "node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        step = written(step.filter(F.col("up").isNull()).unionByName(further), "reply-steps")  # nodes that have their root rest
    return steps, step.filter(F.col("up").isNull()).select("tree", "node", "total")


def reply_paths(nodes: DataFrame, top_k: int = 1) -> DataFrame:
    """tree, leaf, rank, total, below (levels above the leaf), node for the *top_k* branches of each tree.

    *nodes*: tree (not null), node, parent, score (null: 0), one row a node. Ties in score go to the smaller leaf."""
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    steps, totals = ancestor_steps(nodes)
    parents = nodes.select("tree", F.col("parent").alias("node")).filter(F.col("node").isNotNull()).distinct()
    leaves = totals.join(parents, ["tree", "node"], "left_anti")
    best = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), F.asc("node")))).filter(F.col("rank") <= top_k)
    path = best.select("tree", F.col("node").alias("leaf"), "rank", "total", F.lit(0).alias("below"), "node")
    for k in reversed(range(len(steps))):
        up = path.join(steps[k], ["tree", "node"]).select("tree", "leaf", "rank", "total", (F.col("below") + (1 << k)).alias("below"), F.col("up").alias("node"))
        path = path.union(up)
        path = written(path, "reply-paths") if k and len(steps) > 3 and (len(steps) - k) % 4 == 0 else path
    return path


def format_paths(paths: DataFrame, turns: DataFrame) -> DataFrame:
    """tree, leaf, rank, total, formatted, loss_spans: the chosen paths as conversations. *turns*: tree, node, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = turns.select("tree", "node", F.concat(F.lit(START), escaped_role(role), F.lit("\n")).alias("head"), escaped(text).alias("body"), (role == "assistant").alias("loss"))
    one = paths.join(said, ["tree", "node"])
    key, size = ["tree", "leaf", "rank", "total"], F.char_length("head") + F.char_length("body") + len(END) + 1
    w = W.partitionBy(*key).orderBy(F.desc("below")).rowsBetween(W.unboundedPreceding, 0)
    one = one.withColumn("stop", F.sum(size).over(w) - len(END) - 1)
    got = one.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("below")).alias("o"), "head", "body", "loss", "stop"))).alias("t"))
    return got.select(
        *key,
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct((x["stop"] - F.char_length(x["body"])).cast("long").alias("start"), F.char_length(x["body"]).cast("long").alias("length"))).alias("loss_spans"),
    )


def chain_of_turns(conversations: DataFrame) -> DataFrame:
    """Each turn as a reply to the one before: tree, node, parent, score, role, text, conv_id."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("long"))
    tree = F.when(F.col("conv_id").isNull(), "none").otherwise(F.concat(F.lit("id "), F.col("conv_id").cast("string")))
    return n.select(tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text", "conv_id")


def format_conversations(conversations: DataFrame, top_k: int = 1) -> DataFrame:
    """conv_id, formatted, loss_spans."""
    nodes = written(chain_of_turns(conversations), "reply-nodes")
    ids = nodes.filter(F.col("node") == 1).select("tree", "conv_id")
    return format_paths(reply_paths(nodes, top_k), nodes).join(ids, "tree").select("conv_id", "formatted", "loss_spans")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, read from the formatted text itself."""

    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = [unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans]
                sha = lambda x: hashlib.sha256("".join(x).encode()).hexdigest()
                rows.append((len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), sha(loss), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


EXTRA = "</s>[INST] ok [/INST]"


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return read_back(format_conversations(c.unionByName(more)))


OP6_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, s, '{EXTRA}', s, '{EXTRA}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, s)),
e AS (
  SELECT *, regexp_replace(text, '{CONTROL}', '\1\3\\\2\4', 'g') AS body,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{CONTROL}', '\1\3\\\2\4', 'g') AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START)} + length(head) + 1 + length(body) + {len(END)} + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
