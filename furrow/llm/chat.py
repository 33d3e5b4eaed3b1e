"""Chat formatting as a prefix tree.

Conversations that share their first turns share the tokens of those turns. A turn's place in the tree is
named by the digest of all turns up to it; runs of turns without a branch or an end between them make one
segment. Each tree's segments are emitted once, depth first. A segment has its token ids, its offset in its tree's tokens, the
positions of its tokens in the conversation (the first follows the tokens of its ancestors), the intervals of the tree's tokens that it
may attend to (its ancestors'), and the loss mask: the intervals of its own tokens and characters that are assistants' texts.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash and the bar of ``<|`` get a
backslash before them, so no control string can appear there, and reading back undoes it.
"""

import hashlib
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import checkpointed, scratch
from furrow.llm.tokens import decoder, encoder

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str, line: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if line else out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, and what stands after it."""
    return f"{START}{escape(role, line=True)}\n", escape(text), f"{END}\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation; an error if anything else is in it."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


_TURN_ROW = "struct<node:string,text:string,ids:array<int>,loss:struct<start:int,end:int,first:int,last:int>>"
_CHAIN = f"conv_id long, n_turns int, leaf string, turns array<{_TURN_ROW}>"


def _chain(tokenizer: dict, loss_role: str):
    """Conversations to their chains of nodes. Head, text and tail of a turn are encoded each alone, so that no token lies on both sides
    of the mask's edge. loss: the tokens and characters under the mask."""

    def run(batches):
        encode = encoder(**tokenizer) if tokenizer else lambda texts: [[ord(c) for c in x] for x in texts]
        for batch in batches:
            rows = []
            for conv_id, turns in zip(batch["conv_id"], batch["turns"]):
                name, chain = b"", []
                for t in turns:
                    parts = format_turn(t["role"], t["text"])
                    name = hashlib.blake2b(name + "".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    ids = encode(list(parts))
                    k, c = len(ids[0]), len(parts[0])
                    loss = {"start": k, "end": k + len(ids[1]), "first": c, "last": c + len(parts[1])} if t["role"] == loss_role else None
                    chain.append({"node": name.hex(), "text": "".join(parts), "ids": [*ids[0], *ids[1], *ids[2]], "loss": loss})
                rows.append((conv_id, len(chain), chain[-1]["node"], chain))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "leaf", "turns"])

    return run


_SPANS = "array<struct<start:int,end:int>>"
_SEGMENT = f"segment_id string, tree_id string, path array<string>, text string, ids array<int>, length long, position long, loss {_SPANS}, loss_chars {_SPANS}"


def _segments(batches):
    """Chains with their marks, (place, whether it is this chain's to emit) of each segment's last turn in order, to their own segments."""
    for batch in batches:
        rows = []
        for turns, marks in zip(batch["turns"], batch["marks"]):
            path, first, position = [], 0, 0
            for mark in marks:
                part = turns[first : mark["i"] + 1]
                path.append(part[-1]["node"])
                length = sum(len(t["ids"]) for t in part)
                if mark["own"]:
                    ids, text, loss, chars = [], [], [], []
                    n = 0
                    for t in part:
                        if t["loss"] is not None:
                            loss.append({"start": len(ids) + t["loss"]["start"], "end": len(ids) + t["loss"]["end"]})
                            chars.append({"start": n + t["loss"]["first"], "end": n + t["loss"]["last"]})
                        ids.extend(t["ids"])
                        text.append(t["text"])
                        n += len(t["text"])
                    rows.append((path[-1], turns[0]["node"], list(path), "".join(text), ids, length, position, loss, chars))
                position += length
                first = mark["i"] + 1
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SEGMENT.split(", ")])


def prefix_tree(conversations: DataFrame, tokenizer: dict | None = None, loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(tree, members).

    tree, a row per segment: tree_id, segment_id, path (ids of its ancestors' segments and its own), text, ids (its tokens), length,
    tree_offset, position (of its first token), position_ids (of all), attends (array of (start, end) in the tree's tokens, its
    ancestors in order), loss and loss_chars (arrays of (start, end) of the segment's tokens and code points under the loss mask: the
    texts of loss_role's turns). The metadata of ids name the tokenizer.
    members, a row per conversation: conv_id, segment_id (that of its last turn), n_turns.

    conversations needs conv_id, turn, role and text; other columns are ignored. Turns are in the order of turn, then role, then
    text, nulls first; null roles and texts count as empty. A repeated row is a turn of its own. A null conv_id is a conversation of its own. Tokens are
    those of the tokenizer (see tokens.encoder), whose files lie at the same paths everywhere, or code points without one. No rows give no
    rows. Both are written tables (see common.scratch).

    Trees may hold any share of the rows: turns meet by narrow rows of their names, each segment's text and tokens are emitted by one of its
    conversations, segments are dealt by ranges of their path, and offsets are sums of sums.
    """
    with scratch(conversations.sparkSession) as result:
        tree, members = _tree(conversations, tokenizer, loss_role)
        return result(tree, "tree"), result(members, "members")


def _tree(conversations: DataFrame, tokenizer: dict | None, loss_role: str) -> tuple[DataFrame, DataFrame]:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chains = checkpointed(turns.select(F.col("conv_id").cast("long"), "turns").mapInPandas(_chain(tokenizer or {}, loss_role), _CHAIN))
    members = chains.select("conv_id", F.col("leaf").alias("segment_id"), "n_turns")
    different = checkpointed(chains.select("leaf", "turns").dropDuplicates(["leaf"]))

    # A segment ends where a node has several children or a conversation ends; the least of the conversations through it emits it.
    names = different.select("leaf", F.transform("turns", lambda t: t["node"]).alias("nodes"))
    steps = checkpointed(names.select("leaf", F.posexplode(F.arrays_zip("nodes", F.slice("nodes", F.lit(2), F.size("nodes")).alias("child"))).alias("i", "x")).select("leaf", "i", F.col("x.nodes").alias("node"), "x.child"))
    branches = steps.where("child is not null").select("node", "child").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    breaks = branches.union(different.select("leaf")).distinct()
    ends = checkpointed(steps.select("leaf", "i", "node").join(breaks, "node"))
    owners = ends.groupBy("node").agg(F.min("leaf").alias("owner"))
    mark = F.struct("i", (F.col("leaf") == F.col("owner")).alias("own"))
    marks = ends.join(owners, "node").groupBy("leaf").agg(F.sort_array(F.collect_list(mark)).alias("marks"))
    parts = different.join(marks, "leaf").select("turns", "marks").mapInPandas(_segments, _SEGMENT)

    # Depth first: a path sorts after its beginnings and before its later siblings'.
    order = F.concat_ws("/", "path")
    ordered = checkpointed(parts.withColumn("order", order).repartitionByRange("tree_id", "order").sortWithinPartitions("tree_id", "order").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", "tree_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("part", "tree_id").agg(F.sum("length").alias("part_length"))
    before = sums.withColumn("before", F.coalesce(F.sum("part_length").over(Window.partitionBy("tree_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = checkpointed(
        ordered.withColumn("here", F.coalesce(F.sum("length").over(here), F.lit(0)))
        .join(before.drop("part_length"), ["part", "tree_id"])
        .withColumn("tree_offset", (F.col("here") + F.col("before")).cast("long"))
        .drop("order", "part", "here", "before")
    )

    up = placed.select("segment_id", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("k", "up_id"))
    spans = placed.select(F.col("segment_id").alias("up_id"), F.struct(F.col("tree_offset").alias("start"), (F.col("tree_offset") + F.col("length")).alias("end")).alias("span"))
    attends = up.join(spans, "up_id").groupBy("segment_id").agg(F.sort_array(F.collect_list("span")).alias("attends"))
    columns = ["tree_id", "segment_id", "path", "text", "ids", "length", "tree_offset", "position", "position_ids", "attends", "loss", "loss_chars"]
    tree = placed.join(attends, "segment_id", "left").withColumn("attends", F.coalesce("attends", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    noted = F.col("ids").alias("ids", metadata={"tokenizer": json.dumps(tokenizer or {})})
    tree = tree.withColumn("position_ids", F.sequence("position", F.col("position") + F.col("length") - 1))
    return tree.select([noted if c == "ids" else c for c in columns]), members


_SPOKEN = "up_id string, text string, masked array<string>, length long, position long, tree_offset long, attends array<struct<start:bigint,end:bigint>>"
_READ = "segment_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _spoken(tokenizer: dict):
    """Segments to what their tokens say: the text of all, the texts under the token mask, and where they stand."""

    def run(batches):
        decode = decoder(**tokenizer) if tokenizer else lambda ids: "".join(map(chr, ids))
        for batch in batches:
            rows = []
            for up_id, ids, position_ids, loss, tree_offset, attends in zip(*(batch[c] for c in ("segment_id", "ids", "position_ids", "loss", "tree_offset", "attends"))):
                ids, positions = [int(i) for i in ids], np.asarray(position_ids)
                if not ids or len(positions) != len(ids) or (np.diff(positions) != 1).any():
                    raise ValueError(f"positions of {up_id} don't follow one another, one a token")
                masked = [unescape(decode(ids[x["start"] : x["end"]])) for x in loss]
                rows.append((up_id, decode(ids), masked, len(ids), int(positions[0]), tree_offset, attends))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SPOKEN.split(", ")])

    return run


def _read(batches):
    for batch in batches:
        rows = []
        for segment_id, parts in zip(batch["segment_id"], batch["parts"]):
            loss, seen, at = [], [], 0
            for p in parts:
                # A token's position is the number of tokens it may attend to; the intervals must be those of the segments before.
                if p["position"] != at or [(a["start"], a["end"]) for a in p["attends"]] != seen:
                    raise ValueError(f"positions or attention of {segment_id} don't follow its path")
                at += p["length"]
                seen.append((p["tree_offset"], p["tree_offset"] + p["length"]))
                loss.extend(p["masked"])
            formatted = "".join(p["text"] for p in parts)
            turns, masked = read_turns(formatted), "".join(loss)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((segment_id, len(turns), _sha(whole), len(masked), _sha(masked), len(formatted)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _READ.split(", ")])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def read_back(tree: DataFrame, members: DataFrame, tokenizer: dict | None = None) -> DataFrame:
    """One row per conversation, read from the emitted tokens alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Texts are decoded from ids, the loss text from the ids under the segments' token masks; the tree's text and
    loss_chars are not looked at. The tokenizer is the one noted at the ids column by prefix_tree(), unless given. An error if a token's
    position doesn't follow the one before, if the positions or attention intervals of a conversation's segments don't follow its path, or
    if the decoded text isn't made of whole turns. Each segment is decoded once; its ids and positions stay there, and only texts move to the
    conversations through it."""
    noted = tree.schema["ids"].metadata.get("tokenizer")
    tokenizer = tokenizer or (json.loads(noted) if noted else {})
    spoken = tree.select("segment_id", "ids", "position_ids", "loss", "tree_offset", "attends").mapInPandas(_spoken(tokenizer), _SPOKEN)
    leaves = members.select("segment_id").distinct()
    paths = tree.select("segment_id", F.posexplode("path").alias("k", "up_id")).join(leaves, "segment_id", "left_semi")
    part = F.struct("k", "text", "masked", "length", "position", "tree_offset", "attends").alias("part")
    whole = paths.join(spoken, "up_id").select("segment_id", part).groupBy("segment_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    read = checkpointed(whole.mapInPandas(_read, _READ))
    return members.select("conv_id", "segment_id").join(read, "segment_id").drop("segment_id")
