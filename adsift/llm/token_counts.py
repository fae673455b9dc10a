"""Token counts from a tokenizer compiled to a finite-state transducer.

A piece tokenizer of the byte-pair kind joins neighbouring symbols, the best ranked
piece first.  Read from left to right, the segmentation of a text changes in its
last pieces only: the last piece of each prefix is the one whose neighbour on the
left would not have been joined with it in another way.  So a deterministic machine
can read the text once.  Its state holds the places where a piece may still begin:
the trie node reached since, the piece that ends there, and the tokens counted
since.  Each transition is annotated with the change of the token count, and
characters that no piece holds set the state back to the start.  States and
transitions are compiled when a worker first meets them and kept by it.

A text is read in chunks of bounded size.  What a chunk does is a map from the state
before it to a count and the state after it.  Of the states before, only those matter
that reading into the chunk can lead to: all ways to enter it that begin at one of the
few places before its border are read side by side, and nearly always they merge
within some characters.  So a chunk's map goes from some characters behind its border
to as many behind the next one, and holds one or few states: it is small however long
the chunk is.  Such maps compose associatively.  Texts of one chunk are counted where
they are read; the chunks of longer ones are spread over the cluster, and their maps are
composed in groups of neighbours, the results again, until one is left.  A text whose
state is in no map at some border has none left and is read from its beginning instead.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.common import own_columns, stage

SPACE = "▁"
#: Characters of a chunk.
CHUNK = 1 << 15
#: Characters behind a chunk's border at which its map begins, and places before the border at
#: which a state may have begun.
LOOK, BEFORE = 512, 16
#: Neighbouring maps that are composed at once.
TOGETHER = 64
#: A worker forgets its compiled states beyond so many transitions.
MOST_TRANSITIONS = 500_000


class Pieces:
    """The pieces of a sentencepiece model of the byte-pair kind, and their ranks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        probe = model.encode("a  b ", out_type=str)
        if "".join(probe) != f"{SPACE}a{SPACE}{SPACE}b{SPACE}" or not model.is_byte(
            model.encode("\n")[-1]
        ):
            raise ValueError("a model with a leading blank, all blanks kept and bytes is needed")

    @functools.cached_property
    def trie(self) -> dict[str, tuple[str | None, bool]]:
        """The nodes of the trie by the text that leads to them: the piece that ends
        there, and whether longer ones go on.

        Characters that only occur inside pieces are pieces for this purpose.
        """
        inner = {piece[:i] for piece in self.rank for i in range(1, len(piece))}
        ends = {*self.rank, *(c for piece in self.rank for c in piece)}
        return {text: (text if text in ends else None, text in inner) for text in inner | ends}

    def cost(self, piece: str) -> int:
        """Tokens of a piece; characters without a piece fall back to bytes."""
        return 1 if piece in self.rank else len(piece.encode())

    @functools.cache  # noqa: B019
    def edges(self, piece: str) -> tuple[tuple, tuple, bool]:
        """How a piece is built up: the symbols at its left and its right edge, each
        with the rank at which it is joined into the next; whether joining ends in
        the piece as a whole."""
        symbols, left, right = list(piece), [], []
        while len(symbols) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(symbols, symbols[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            if i == 0:
                left.append((symbols[0], best))
            if i == len(ranks) - 1:
                right.append((symbols[-1], best))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        left.append((symbols[0], float("inf")))
        right.append((symbols[-1], float("inf")))
        return tuple(left), tuple(right), len(symbols) == 1

    def stay_apart(self, right: tuple, b: str) -> bool:
        """Whether a piece stays apart from its left neighbour, given the right
        edge of that one.

        Both build up on their own until a symbol of one joins with a symbol of
        the other.  That happens if the two are edges at the same time and
        their join ranks before what either does next; of equal ranks the left
        one is joined first.
        """
        left = self.edges(b)[0]
        i = j = 0
        while True:
            (x, x_next), (y, y_next) = right[i], left[j]
            rank = None if x is None else self.rank.get(x + y)
            if rank is not None and rank < x_next and rank <= y_next:
                return False
            if x_next == y_next == float("inf"):
                return True
            if x_next <= y_next:
                i += 1
            else:
                j += 1

    @functools.cache  # noqa: B019
    def may_join(self, x: str, text: str) -> bool:
        """Whether a symbol could join with the beginning of a piece that starts
        with the text."""
        if x + text in self.trie:
            return True
        return any(x + text[:i] in self.rank for i in range(1, len(text)))

    @functools.cache  # noqa: B019
    def relevant(self, right: tuple, text: str) -> tuple | None:
        """A right edge without the symbols that cannot join what follows, so that
        neighbours which make no difference give the same state."""
        kept: list[tuple] = []
        for x, after in right:
            x = x if x is not None and self.may_join(x, text) else None
            if kept and x is None and kept[-1][0] is None:
                kept.pop()
            kept.append((x, after))
        return tuple(kept) if any(x is not None for x, _ in kept) else None


class Transducer:
    """States are dicts from a character to ``(next state, change of the count)``.

    A state's description, under the key ``""``, is a tuple of places where a piece
    may begin: ``(text since, right edge of the piece that ends there, tokens since)``.
    """

    def __init__(self, pieces: Pieces, most: int = MOST_TRANSITIONS):
        self.pieces, self.most = pieces, most
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.made = 0
        self.start = self.state((("", None, 0),))

    def state(self, described: tuple) -> dict:
        found = self.states.get(described)
        if found is None:
            found = self.states[described] = {"": described}
        return found

    def grow(self, state: dict, c: str) -> tuple[dict, int]:
        """Compile the transition of a state by a character."""
        if self.made >= self.most:
            described = state[""]
            self._clear()
            state = self.state(described)
        self.made += 1
        pieces = self.pieces
        if c not in pieces.trie:
            step = self.start, len(c.encode())
        else:
            alive, last, change = [], None, 0
            for text, edge, since in state[""]:
                text += c
                node = pieces.trie.get(text)
                if node is None:
                    continue
                edge = edge and pieces.relevant(edge, text)
                piece, goes_on = node
                if piece and last is None and pieces.edges(piece)[2]:
                    if edge is None or pieces.stay_apart(edge, piece):
                        last, change = piece, pieces.cost(piece) - since
                if goes_on:
                    alive.append((text, edge, since))
            places = [(text, edge, since + change) for text, edge, since in alive]
            step = self.state((*places, ("", pieces.edges(last)[1], 0))), change
        state[c] = step
        return step

    def read(self, text: str, state: dict) -> tuple[dict, int]:
        """The state after a text, and the change of the count."""
        total = 0
        for c in text:
            try:
                state, change = state[c]
            except KeyError:
                state, change = self.grow(state, c)
            total += change
        return state, total

    def entered(self, text: str, border: int, at: int) -> list[dict]:
        """The different states at a place, of all readings that begin before a border."""
        usual, state = [], self.start
        for c in text[border:at]:
            state = self.read(c, state)[0]
            usual.append(state)
        found = {state[""]: state}
        for begin in range(border):
            state, merged = self.start, False
            for i in range(begin, at):
                state = self.read(text[i], state)[0]
                if merged := i >= border and state is usual[i - border]:
                    break
            if not merged:
                found.setdefault(state[""], state)
        return list(found.values())

    def chunk_map(self, text: str, border: int, look: int = LOOK) -> list[tuple[bytes, int, bytes]]:
        """What a chunk does, given with what stands before its border and what follows it:
        from each state ``look`` characters behind the border, the count and the last state.

        The first chunk of a text has nothing before it and is read from its beginning.
        """
        at = min(border + look, len(text)) if border else 0
        steps = []
        for state in self.entered(text, border, at) if border else [self.start]:
            described = state[""]
            last, count = self.read(text[at:], state)
            steps.append((_digest(described), count, _digest(last[""])))
        return steps

    def count(self, text: str) -> int:
        return self.read(marked(text), self.start)[1]


def _digest(described: tuple) -> bytes:
    return hashlib.blake2b(repr(described).encode(), digest_size=16).digest()


def cut(text: str, size: int = CHUNK, look: int = LOOK, before: int = BEFORE) -> Iterator[tuple[str, int]]:
    """The chunks of a text with what stands around them, and where in each its border is."""
    for i in range(0, len(text), size):
        border = min(i, before)
        yield text[i - border : i + size + look], border


def composed(maps: list[list[tuple[bytes, int, bytes]]]) -> list[tuple[bytes, int, bytes]]:
    """Neighbouring maps, in order, as one; ways that lead to a state which the next lacks end."""
    steps = maps[0]
    for following in maps[1:]:
        then = {entry: (count, last) for entry, count, last in following}
        steps = [(e, n + then[x][0], then[x][1]) for e, n, x in steps if x in then]
    return steps


def marked(text: str) -> str:
    """The text as the pieces have it: a leading blank, and blanks as marks."""
    return SPACE + text.replace(" ", SPACE) if text else ""


@functools.cache
def transducer(path: str) -> Transducer:
    """One for each worker process."""
    return Transducer(Pieces(path))


def _counts(name: str):
    """Count texts of one chunk; ``(doc_id, n_bytes, text)`` batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(SparkFiles.get(name))
        for batch in batches:
            counts = [machine.read(marked(t), machine.start)[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


_CHUNKS = "doc_id long, digest long, part long, border int, text string"
_MAPS = "doc_id long, digest long, part long, steps array<struct<entry: binary, count: long, last: binary>>"
_STEPS = pa.list_(pa.struct([("entry", pa.binary()), ("count", pa.int64()), ("last", pa.binary())]))


def _steps(maps: list[list[tuple[bytes, int, bytes]]]) -> pa.Array:
    return pa.array([[dict(zip(("entry", "count", "last"), s)) for s in m] for m in maps], _STEPS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text"))):
            parts = list(cut(marked(text)))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array([doc_id] * len(parts), pa.int64()),
                 "digest": pa.array([digest] * len(parts), pa.int64()),
                 "part": pa.array(range(len(parts)), pa.int64()),
                 "border": pa.array([border for _, border in parts], pa.int32()),
                 "text": pa.array([t for t, _ in parts], pa.string())}
            )


def _maps(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(SparkFiles.get(name))
        for batch in batches:
            chunks = zip(batch.column("text").to_pylist(), batch.column("border").to_pylist())
            done = [machine.chunk_map(text, border) for text, border in chunks]
            yield pa.RecordBatch.from_pydict(
                {**{c: batch.column(c) for c in ("doc_id", "digest", "part")}, "steps": _steps(done)}
            )

    return run


def _compose(key: tuple, table: pa.Table) -> pa.Table:
    """Neighbouring maps of a text as one, numbered among the others like it."""
    table = table.sort_by("part")
    maps = [[(s["entry"], s["count"], s["last"]) for s in m] for m in table.column("steps").to_pylist()]
    return pa.table(
        {**{c: table.column(c).slice(0, 1) for c in ("doc_id", "digest")},
         "part": pa.array([key[2].as_py()], pa.int64()), "steps": _steps([composed(maps)])}
    )


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every document.

    ``model_path`` is the model's file where the driver runs; it has a few
    hundred kilobytes and is sent to the workers.  Null and empty texts have no
    bytes and no tokens.  Counts are those of the model's library, without
    begin and end tokens.  Rows that repeat are counted each; no rows give none.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]
    own = own_columns(docs, doc_id="long", text="string")
    text = F.coalesce(own["text"], F.lit(""))
    rows = docs.select(
        own["doc_id"].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    # The mark in front counts.
    short = rows.where(F.length("text") < CHUNK).mapInArrow(
        _counts(name), "doc_id long, n_bytes long, n_tokens long"
    )
    long = rows.where(F.length("text") >= CHUNK)
    long = long.withColumn("digest", F.xxhash64("text"))
    parts = long.select("doc_id", "digest", "text").mapInArrow(_cut, _CHUNKS)
    maps = (
        parts.repartition("doc_id", "digest", "part")
        .mapInArrow(_maps(name), _MAPS)
        # Rows with equal id and text have equal parts.
        .dropDuplicates(["doc_id", "digest", "part"])
    )
    maps = stage(maps, "token-maps")
    most = (maps.agg(F.max("part")).first()[0] or 0) + 1
    while most > 1:
        neighbours = F.expr(f"part div {TOGETHER}").alias("neighbours")
        maps = maps.groupBy("doc_id", "digest", neighbours).applyInArrow(_compose, _MAPS)
        most = -(-most // TOGETHER)
    folded = stage(
        maps.select(F.col("doc_id").alias("k"), F.col("digest").alias("d"), F.get("steps.count", F.lit(0)).alias("n_tokens")),
        "token-folds",
    )
    same = F.expr("doc_id <=> k AND digest = d")
    counted = long.drop("text").join(folded.where("n_tokens IS NOT NULL"), same).select("doc_id", "n_bytes", "n_tokens")
    counted = short.unionAll(counted)
    open_ = folded.where("n_tokens IS NULL")
    if open_.isEmpty():
        return counted
    again = long.join(open_, same, "left_semi").drop("digest")
    return counted.unionAll(again.mapInArrow(_counts(name), "doc_id long, n_bytes long, n_tokens long"))


def over_limit(n_tokens: Column, limit: int = 4096) -> Column:
    return n_tokens > limit
