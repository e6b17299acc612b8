"""Chat formatting over prefix trees: turns that conversations share at their beginning are put out once.

Template. A turn is `<s>` role `[INST]` text `[/INST]</s>`. Control strings inside roles and texts are broken by a
backslash after their first character, and backslashes are doubled, so that no control string of a text is taken for
one of the template and unescape() gives the text back.

Tokens. Head, body and end of a turn are tokenized apart by a byte-level vocabulary, so that texts come back whole
and the loss mask begins and ends between tokens. Each turn of a tree is tokenized once, whoever shares it.

Trees. Conversations are ordered by the chain of their turns' digests, so conversations with equal first turns stand
side by side and a turn stands before all that follow it: a depth-first walk of the tree. Range partitioning by that
chain, and then by id, deals out a first turn (or a whole conversation) that is very common over many tasks. Each task
reads its range in order and keeps the current path only. A tree is one row, so one with more than `most_tokens`
tokens or `most_conversations` conversations is continued in another, which begins with the current path again: shared
turns are put out once in each row, and a row holds all that its tokens may attend to.

A tree's row has its tokens and one segment for each turn: its place [start, end), the position id of its first
token (positions run on from the parent's), the intervals of its ancestors, which with its own preceding tokens are all
it may attend to, its loss interval if an assistant says it, and the conversations that end there.

Defined results: null texts and roles are empty; turns of equal number are ordered by role and text, repeated rows are
turns of their own; each row without a conversation id is a conversation of its own; an empty table gives no trees;
other columns, whatever their names, are not looked at. A conversation must fit a row; a very long text is one segment
(and closes its tree).
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow, small_batches

#: Control strings of common chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, SAYS, CLOSE = "<s>", "[INST]", "[/INST]</s>"
_CONTROL = re.compile("|".join(sorted(map(re.escape, CONTROL), key=len, reverse=True)))
_BACK = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, begin and end of its text inside)."""
    head = OPEN + escape(role) + SAYS
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


SEGMENT = "start:long,end:long,parent:int,position:long,attends:array<struct<start:long,end:long>>,loss_start:long,loss_end:long,conversations:array<{kind}>"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1024)
def frame(vocabulary: str, text: str) -> list[int]:
    """The tokens of a part of the template, which recurs in every turn."""
    return tokenizer(vocabulary).encode(text, add_special_tokens=False).ids


class Tree:
    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self.tokens: list[int] = []
        self.segments: list[dict] = []
        self.path: list[tuple[str, str, int]] = []  # role, text, number of the segment
        self.ends = 0

    def shared(self, turns: list[tuple[str, str]]) -> int:
        """How many first turns the path so far has in common."""
        n = 0
        while n < min(len(self.path), len(turns)) and self.path[n][:2] == turns[n]:
            n += 1
        return n

    def add(self, turns: list[tuple[str, str]], conversation, learns: str) -> None:
        known = self.shared(turns)
        del self.path[known:]
        for role, text in turns[known:]:
            body = tokenizer(self.vocabulary).encode_batch_fast([escape(text)], add_special_tokens=False)[0].ids
            parts = [frame(self.vocabulary, OPEN + escape(role) + SAYS), body, frame(self.vocabulary, CLOSE)]
            begin = len(self.tokens) + len(parts[0])
            parent = self.path[-1][2] if self.path else -1
            attends: list[dict] = []
            position = 0
            if parent >= 0:
                above = self.segments[parent]
                position = above["position"] + above["end"] - above["start"]
                attends = [*above["attends"]]
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1] = {"start": attends[-1]["start"], "end": above["end"]}
                else:
                    attends.append({"start": above["start"], "end": above["end"]})
            loss = role == learns
            self.path.append((role, text, len(self.segments)))
            start = len(self.tokens)
            for ids in parts:
                self.tokens += ids
            self.segments.append({"start": start, "end": len(self.tokens), "parent": parent, "position": position, "attends": attends, "loss_start": begin if loss else None, "loss_end": begin + len(parts[1]) if loss else None, "conversations": []})
        self.segments[self.path[-1][2]]["conversations"].append(conversation)
        self.ends += 1


def build_trees(df: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learns: str = "assistant", most_tokens: int = 1 << 16, most_conversations: int = 2000) -> DataFrame:
    """(tokens, segments): one row for each tree. vocabulary: file of a byte-level vocabulary for the tokenizers library."""
    kind = df.schema[conv_col].dataType.simpleString()
    spark = df.sparkSession
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = df.select(F.col(conv_col).alias("conv"), turn.alias("turn"))
    whole = rows.filter("conv is not null").groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = whole.unionByName(rows.filter("conv is null").select("conv", F.array("turn").alias("turns")))
    whole = whole.select("conv", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    turns_type = "array<struct<role:string,text:string>>"

    def chain(batch: pa.RecordBatch) -> dict:
        paths = []
        for turns in batch.column(1).to_pylist():
            at, path = 0, bytearray()
            for t in turns:
                at = xxhash.xxh3_64_intdigest(f"{t['role']}\0{t['text']}".encode("utf-8", "replace"), at)
                path += at.to_bytes(8, "big")
            paths.append(bytes(path))
        return {"path": paths, "conv": batch.column(0), "turns": batch.column(1)}

    chained = map_arrow(whole, chain, f"path binary, conv {kind}, turns {turns_type}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = chained.repartitionByRange(parts, "path", "conv").sortWithinPartitions("path", "conv")
    schema = f"tokens array<int>, segments array<struct<{SEGMENT.format(kind=kind)}>>"
    wanted = arrow_schema(schema)
    small_batches(spark)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(vocabulary)
        put = lambda t: pa.RecordBatch.from_pylist([{"tokens": t.tokens, "segments": t.segments}], schema=wanted)
        for batch in batches:
            for conv, turns in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = [(t["role"], t["text"]) for t in turns]
                if tree.path and (not tree.shared(turns) or len(tree.tokens) >= most_tokens or tree.ends >= most_conversations):
                    yield put(tree)
                    tree = Tree(vocabulary)
                tree.add(turns, conv, learns)
        if tree.path:
            yield put(tree)

    return ordered.mapInArrow(walk, schema)


def read_tree(tokens: list[int], segments: list[dict], vocabulary: str) -> Iterator[dict]:
    """What each distinct conversation of a tree says: (conversations, formatted, turns, text under the loss mask)."""
    decode = tokenizer(vocabulary).decode_batch
    cuts = [[s["start"], s["end"]] if s["loss_start"] is None else [s["start"], s["loss_start"], s["loss_end"], s["end"]] for s in segments]
    parts = iter(decode([tokens[a:b] for c in cuts for a, b in pairwise(c)], skip_special_tokens=False))
    parts = [[next(parts) for _ in c[1:]] for c in cuts]
    texts, losses = ["".join(p) for p in parts], [p[1] if len(p) == 3 else "" for p in parts]
    for k, s in enumerate(segments):
        if not s["conversations"]:
            continue
        line = [k]
        while (above := segments[line[-1]]["parent"]) >= 0:
            line.append(above)
        line.reverse()
        formatted = "".join(texts[x] for x in line)
        yield {"conversations": s["conversations"], "formatted": formatted, "turns": parse_turns(formatted), "loss": "".join(unescape(losses[x]) for x in line)}


def read_back(trees: DataFrame, vocabulary: str, conv_col: str = "conv_id") -> DataFrame:
    """Each conversation, parsed from the trees: counts and digests of its turns and of its text under the loss mask."""
    kind = trees.schema["segments"].dataType.elementType["conversations"].dataType.elementType.simpleString()
    schema = f"{conv_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def one(batch: pa.RecordBatch) -> dict:
        rows = []
        for row in range(batch.num_rows):
            for c in read_tree(batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), vocabulary):
                turns = "".join(f"{r}\n{t}\n" for r, t in c["turns"])
                found = (len(c["turns"]), hashlib.sha256(turns.encode("utf-8", "replace")).hexdigest(), len(c["loss"]), hashlib.sha256(c["loss"].encode("utf-8", "replace")).hexdigest(), len(c["formatted"]))
                rows += [(x, *found) for x in c["conversations"]]
        names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))

    return map_arrow(trees, one, schema)


def position_ids(segments: list[dict]) -> list[int]:
    """The position id of every token of a tree."""
    return [p for s in segments for p in range(s["position"], s["position"] + s["end"] - s["start"])]


def may_attend(segments: list[dict], query: int, key: int) -> bool:
    """Whether the token at `query` may attend to the one at `key`."""
    own = next(s for s in segments if s["start"] <= query < s["end"])
    return own["start"] <= key <= query or any(i["start"] <= key < i["end"] for i in own["attends"])
