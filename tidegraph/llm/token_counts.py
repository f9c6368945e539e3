"""Token counts by a finite-state transducer compiled from the model's pieces.

Merging in the model's order gives every text one sequence of pieces, and a
sequence is that of its text exactly if each two neighbours are what merging
makes of the two of them. So the last piece of a prefix follows from the last
pieces of shorter prefixes: it is the one suffix that is a piece and goes with
the last piece of what stands before it.

A state of the transducer is what later characters can still depend on: the
longest suffix that some piece goes on from, and at each place in it where a
piece may have begun the last piece there and the tokens since the first such
place. A transition reads a character and carries the tokens that are settled
by it; a state's final weight are those not settled yet. Pieces are short, so
states are finitely many. States are made when first met, in a table of bounded
size that is emptied when full, and so are the paths of words from a state, so
that a word met before is one step. Two characters that are nowhere side by side in
a piece separate what is before from what is after.

A text of over `long_bytes` is cut into chunks that are dealt over tasks. A
chunk's map sends an entry state to its exit state and tokens; the entry is the
state that the characters before the chunk lead to. Neighbouring maps compose
where exit and entry agree, pairs of chunks into pairs of pairs, as a parallel
scan does; where they don't, the chunk is read again from the state needed.

Defined results: null counts as empty; empty has 0 tokens; repeated rows and
ids are counted each; a text of any length is counted whole; an empty table
gives an empty result; only doc_id and text are read, so extra columns of any
name do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.batches import PIECE, pieces
from tidegraph.llm.common import checkpointed, parallel

#: The model's mark for a space.
MARK = "▁"
#: Characters of a word whose path is kept.
WORD = 64
#: Characters before a chunk that its entry state is taken from.
BEFORE = 256


class Paths(dict):
    """Paths of whole words from a state: the state they lead to and the tokens settled."""

    __slots__ = ("state",)

    def __missing__(self, word: str) -> tuple[State, int]:
        state, tokens = self.state, 0
        for char in word:
            state, settled = state[char]
            tokens += settled
        if len(word) <= WORD:
            self.state.machine.keep(self)[word] = state, tokens
        return state, tokens


class State(dict):
    """Transitions by character: the next state and the tokens settled."""

    __slots__ = ("machine", "suffix", "live", "final", "paths")

    def __missing__(self, char: str) -> tuple[State, int]:
        made = self[char] = self.machine.transition(self, char)
        return made


class Transducer:
    """The pieces of a model, and the states made so far."""

    def __init__(self, path: str, most_states: int = 200_000, most_paths: int = 500_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds, text = model.SentencePiece, model.normalizer_spec
        plain = not text.precompiled_charsmap and text.add_dummy_prefix and text.escape_whitespaces and not text.remove_extra_whitespaces
        known = all(p.type in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) for p in model.pieces)
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or not plain or not known:
            raise ValueError("not a model of merged pieces with byte fallback and texts taken as they are")
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.prefixes = {p[:i] for p in self.scores for i in range(1, len(p))}
        self.beside = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.most_states, self.most_paths, self.kept = most_states, most_paths, 0
        self.agreed: dict[tuple[str | None, str], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self.state("", ((0, None, 0),))

    def state(self, suffix: str, live: tuple) -> State:
        """The state of a suffix and of (place in it, last piece before it, tokens up to it) where a piece may have begun."""
        made = self.states.get((suffix, live))
        if made is None:
            if len(self.states) >= self.most_states:
                for old in self.states.values():
                    old.clear()
                    old.paths.clear()
                self.states.clear()
                self.kept = 0
                self.agreed.clear()
            made = State()
            made.machine, made.suffix, made.live, made.final, made.paths = self, suffix, live, live[-1][2], Paths()
            made.paths.state = made
            self.states[suffix, live] = made
        return made

    def keep(self, paths: Paths) -> Paths:
        """paths, with room for one more; all are emptied when there are too many."""
        if self.kept >= self.most_paths:
            self.kept = 0
            for state in self.states.values():
                state.paths.clear()
        self.kept += 1
        return paths

    def merged(self, text: str) -> list[str]:
        """A short text's pieces: of neighbours that make a piece, the best goes first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, last: str | None, piece: str) -> bool:
        """Whether the piece can stand after the last one."""
        known = self.agreed.get((last, piece))
        if known is None:
            want = [piece] if last is None else [last, piece]
            known = self.agreed[last, piece] = self.merged("".join(want)) == want
        return known

    def transition(self, state: State, char: str) -> tuple[State, int]:
        suffix, live, settled = state.suffix, state.live, 0
        if suffix and suffix[-1] + char not in self.beside:
            suffix, live, settled = "", ((0, None, 0),), live[-1][2]
        if char not in self.scores:  # stands alone, as its bytes
            return self.state("", ((0, None, 0),)), settled + len(char.encode("utf-8", "replace"))
        suffix += char
        piece, tokens = next((suffix[at:], n + 1) for at, last, n in live if suffix[at:] in self.scores and self.agree(last, suffix[at:]))
        live = (*(x for x in live if suffix[x[0] :] in self.prefixes), (len(suffix), piece, tokens))
        first, _, less = live[0]
        return self.state(suffix[first:], tuple((at - first, last, n - less) for at, last, n in live)), settled + less

    @staticmethod
    def run(state: State, text: str) -> tuple[State, int]:
        """The state that a text leads to, and the tokens settled on the way: marks by transitions, words by paths."""
        head, *words = text.split(MARK)
        state, tokens = state.paths[head]
        for word in words:
            state, settled = state[MARK]
            state, more = state.paths[word]
            tokens += settled + more
        return state, tokens

    def count(self, text: str) -> int:
        if not text:
            return 0
        state, tokens = self.run(self.start, given(text))
        return tokens + state.final

    def named(self, name: str) -> State:
        suffix, live = json.loads(name)
        return self.state(suffix, tuple(map(tuple, live)))


def given(text: str) -> str:
    """What the model reads for a text that isn't empty."""
    return MARK + text.replace(" ", MARK)


def name_of(state: State) -> str:
    return json.dumps([state.suffix, state.live])


@cache
def compiled(path: str) -> Transducer:
    return Transducer(path)


def _machine(path: str | None) -> Transducer:
    import public_tokenizers

    return compiled(path or public_tokenizers.path("piece_bpe_32k.model"))


def _chunks(long: DataFrame, chunk_chars: int) -> DataFrame:
    """row, doc_id, n_bytes, no, before, text: texts in chunks, dealt over tasks."""
    kind = long.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            row, doc = part.column("row"), part.column("doc_id")
            for k, raw in enumerate(texts):
                text = given(raw.decode("utf-8", "replace"))
                for no, at in enumerate(range(0, len(text), chunk_chars)):
                    yield pa.RecordBatch.from_arrays(
                        [row.slice(k, 1), doc.slice(k, 1), pa.array([len(raw)]), pa.array([no]), pa.array([text[max(0, at - BEFORE) : at]]), pa.array([text[at : at + chunk_chars]])], ["row", "doc_id", "n_bytes", "no", "before", "text"]
                    )

    rows = long.withColumn("row", F.monotonically_increasing_id())
    # written once: row numbers must not change between the rounds that read them
    return checkpointed(rows.mapInArrow(cut, f"row long, doc_id {kind}, n_bytes long, no long, before string, text string").repartition("row", "no"))


def _maps(chunks: DataFrame, path: str | None) -> DataFrame:
    """row, no, entry, exit, tokens, final: chunks' maps at the entry given, or at that which the characters before lead to."""
    names = ["row", "no", "entry", "exit", "tokens", "final"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for batch in batches:
            rows = []
            for row, no, entry, before, text in zip(*(batch.column(c).to_pylist() for c in ("row", "no", "entry", "before", "text")), strict=True):
                state = machine.named(entry) if entry is not None else machine.run(machine.start, before)[0]
                entry = name_of(state)
                state, tokens = machine.run(state, text)
                rows.append((row, no, entry, name_of(state), tokens, state.final))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return chunks.select("row", "no", "entry", "before", "text").mapInArrow(run, "row long, no long, entry string, exit string, tokens long, final long")


def _composed(maps: DataFrame, chunks: int) -> DataFrame:
    """The maps of whole texts: neighbours meet, level by level."""
    while chunks > 1:
        half = maps.withColumn("pair", F.floor(F.col("no") / 2))
        a, b = half.where("no % 2 = 0"), half.where("no % 2 = 1").select("row", "pair", F.col("entry").alias("exit"), F.col("exit").alias("_exit"), F.col("tokens").alias("_tokens"), F.col("final").alias("_final"))
        alone = a.join(b.select("row", "pair").distinct(), ["row", "pair"], "left_anti").select("row", F.col("pair").alias("no"), "entry", "exit", "tokens", "final")
        met = a.join(b, ["row", "pair", "exit"]).select("row", F.col("pair").alias("no"), "entry", F.col("_exit").alias("exit"), (F.col("tokens") + F.col("_tokens")).alias("tokens"), F.col("_final").alias("final"))
        maps = checkpointed(met.union(alone))
        chunks = (chunks + 1) // 2
    return maps


def _counted_long(long: DataFrame, path: str | None, chunk_chars: int) -> DataFrame | None:
    """doc_id, n_bytes, tokens of long texts; None if there are none."""
    chunks = _chunks(long, chunk_chars)
    n = chunks.agg(F.max("no")).first()[0]
    if n is None:
        return None
    maps = checkpointed(_maps(chunks.withColumn("entry", F.lit(None).cast("string")), path))
    while True:  # entries that a chunk before leads to and that have no map yet; as states are few, this ends
        needed = maps.select("row", (F.col("no") + 1).alias("no"), F.col("exit").alias("entry")).distinct().join(maps, ["row", "no", "entry"], "left_anti")
        more = checkpointed(_maps(chunks.join(needed, ["row", "no"]), path))
        if more.isEmpty():
            break
        maps = checkpointed(maps.union(more))
    start = name_of(_machine(path).start)
    whole = _composed(maps, n + 1).where(F.col("entry") == start).select("row", (F.col("tokens") + F.col("final")).alias("tokens"))
    return chunks.where("no = 0").select("row", "doc_id", "n_bytes").join(whole, "row").drop("row")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, long_bytes: int = PIECE, chunk_chars: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    path: the model's file, present on every executor; by default the public one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for part, texts in pieces(batches):
            sizes = np.array([len(t) for t in texts], np.int64)
            tokens = np.array([machine.count(t.decode("utf-8", "replace")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(tokens)], ["doc_id", "n_bytes", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    counted = parallel(docs.where(~is_long)).mapInArrow(run, f"doc_id {kind}, n_bytes long, tokens long")
    long = _counted_long(docs.where(is_long), path, chunk_chars)
    if long is not None:
        counted = counted.union(long)
    return counted.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))
