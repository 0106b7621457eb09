"""Byte-level BPE by a recursive DuckDB query in each Spark partition.

A text is cut by the tokenizer's pattern; distinct pieces are encoded once.
Token-position rows of all open pieces join the merge table; each turn contracts
each piece's leftmost pair of minimum rank, until no pair is left. A document's ids
are decoded by an ordered aggregation over the vocabulary's bytes. Pieces are handed
to DuckDB in bounded groups; it runs on one thread within a memory limit.

A piece longer than REACH times the longest token L contracts in one turn every pair
whose rank is the least within that distance on both sides. This equals one contraction
a turn: what a pair's contraction can lead to is one token of L bytes at most, so pairs
farther apart than 2 L cannot meet before the lesser is done. Pairs of equal rank there
go together (of a run of overlapping ones every other, from its left end), up to the
first whose new token would make a pair of lower rank with a token beside it.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, small_batches, table

#: Pieces of one query; and pieces that a worker keeps in each of its two generations.
GROUP = 30_000
KEEP = 350_000
#: DuckDB's memory; a worker that shares its executor has 100 MB.
MEMORY_MB = 250
#: Longest tokens that a pair looks aside.
REACH = 2
#: Rows that a query may gather over its turns; long pieces go on from where it stops.
GATHERED = 3_000_000
#: Bytes of long pieces that are encoded together.
LONG_BYTES = 60_000

#: A row is a token that ends at pos, with the token after it. A pair is packed as rank, pos, next_pos (23 bits a place),
#: so the least of a piece is its leftmost pair of minimum rank; the contracted token takes the later place.
ENCODE = """
WITH RECURSIVE open(word, pos, tok, next_pos, next_tok, done) AS (
  SELECT word, pos, tok, next_pos, next_tok, false FROM first_tokens
  UNION ALL
  SELECT
    p.word, p.pos,
    CASE WHEN p.pos = b.best & 8388607 THEN b.best >> 46 ELSE p.tok END,
    CASE WHEN p.next_pos = (b.best >> 23) & 8388607 THEN b.best & 8388607 ELSE p.next_pos END,
    CASE WHEN p.next_pos = (b.best >> 23) & 8388607 THEN b.best >> 46 ELSE p.next_tok END,
    b.best IS NULL
  FROM open p JOIN (
    SELECT o.word, min((m.id << 46) + (o.pos << 23) + o.next_pos) AS best
    FROM open o LEFT JOIN merges m ON m.l = o.tok AND m.r = o.next_tok WHERE NOT o.done GROUP BY o.word
  ) b ON b.word = p.word
  WHERE NOT p.done AND (b.best IS NULL OR p.pos <> (b.best >> 23) & 8388607)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM open WHERE done GROUP BY word
"""

#: The same for long pieces: {reach} bytes are looked at on both sides, {turns} turns are made at most. A row's token
#: begins a contraction if its own pair goes, and ends one if the pair before it does.
ENCODE_LONG = """
WITH RECURSIVE open(word, pos, tok, next_pos, next_tok, turn) AS (
  SELECT word, pos, tok, next_pos, next_tok, 0 FROM first_tokens
  UNION ALL
  SELECT
    word, pos, coalesce(before, tok),
    CASE WHEN after IS NULL THEN next_pos ELSE after & 8388607 END,
    CASE WHEN after IS NULL THEN next_tok ELSE after >> 23 END,
    turn + 1
  FROM (
    SELECT *, lag(CASE WHEN own THEN rank END) OVER w AS before, own AS goes, lead(CASE WHEN own THEN (rank << 23) + next_pos END) OVER w AS after, bool_or(own) OVER (PARTITION BY word) AS any_
    FROM (
      SELECT *, least_ AND row_number() OVER v % 2 = 1 AND bool_and(least_) OVER v AS own
      FROM (
        SELECT *, coalesce(rank = low AND coalesce(stop >= (rank << 23) + pos, true), false) AS least_, sum(begins) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM (
          SELECT
            q.*, min(rank) OVER near AS low, CASE WHEN rank = lag(rank) OVER (PARTITION BY word ORDER BY pos) THEN 0 ELSE 1 END AS begins,
            min(CASE WHEN least(l.id, r.id, q.twice) < rank THEN (rank << 23) + pos END) OVER near AS stop
          FROM (
            SELECT o.*, m.id AS rank, m.twice, lag(tok) OVER (PARTITION BY word ORDER BY pos) AS left_tok, lead(next_tok) OVER (PARTITION BY word ORDER BY pos) AS right_tok
            FROM open o LEFT JOIN merges m ON m.l = o.tok AND m.r = o.next_tok WHERE o.turn < {turns}
          ) q LEFT JOIN merges l ON l.l = left_tok AND l.r = rank LEFT JOIN merges r ON r.l = rank AND r.r = right_tok
          WINDOW near AS (PARTITION BY word ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)
        )
      )
      WINDOW v AS (PARTITION BY word, run ORDER BY pos)
    )
    WINDOW w AS (PARTITION BY word ORDER BY pos)
  )
  WHERE any_ AND NOT goes
), last AS (SELECT word, max(turn) AS turn FROM open GROUP BY word)
SELECT word, last.turn, list(struct_pack(pos := pos, tok := tok) ORDER BY pos) AS toks FROM open JOIN last USING (word, turn) GROUP BY word, last.turn
"""

#: Ids that a query decodes, about (a document's stay together).
DECODED = 400_000
DECODE = "SELECT word, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocab ON vocab.id = ids.id GROUP BY word"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A .tiktoken file: base64 of a token and its rank, a line each."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: bytes, pattern: str, keep: int = KEEP, group: int = GROUP, memory_mb: int = MEMORY_MB):
        import tempfile

        import duckdb
        import regex

        self.keep, self.group = keep, group
        self.gathered, self.decoded = (x * memory_mb // MEMORY_MB for x in (GATHERED, DECODED))
        self.ranks = read_ranks(ranks)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.reach = REACH * max(map(len, self.ranks))
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        pairs = [(self.ranks[b[:k]], self.ranks[b[k:]], i) for b, i in self.ranks.items() for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "preserve_insertion_order": "false", "temp_directory": tempfile.gettempdir()})
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        twice = [self.ranks.get(self.bytes_of[i] * 2) for i in merged.tolist()]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self._table("merges", l=left, r=right, id=merged, twice=pa.array(twice, pa.int64()))
        self._table("vocab", id=np.array(list(self.bytes_of), np.int64), hex=[b.hex() for b in self.bytes_of.values()])

    def _table(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM incoming")
        self.db.unregister("incoming")

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _first(self, word: np.ndarray, tok: np.ndarray, pos: np.ndarray) -> None:
        """The table that a query starts from: words, tokens, and where these end."""
        last = np.append(word[1:] != word[:-1], True)
        self._table("first_tokens", word=word, pos=pos, tok=tok, next_pos=pa.array(np.append(pos[1:], 0), mask=last), next_tok=pa.array(np.append(tok[1:], 0), mask=last))

    def _short(self, pieces: list[str], raw: list[bytes], todo: list[int]) -> None:
        """Keeps pieces, by their numbers; about half the square of a piece's length is what its turns gather."""
        size = np.fromiter((len(raw[i]) for i in todo), np.int64, len(todo))
        group = np.maximum(np.cumsum(size * size // 2 + 1) // self.gathered, np.arange(len(todo)) // self.group)
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(todo) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part, n = todo[lo:hi], size[lo:hi]
            at = np.cumsum(n) - n
            self._first(np.repeat(np.array(part, np.int64), n), self.single[np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)], np.arange(int(n.sum())) - np.repeat(at, n))
            got = self.db.sql(ENCODE).to_arrow_table()
            ids = got.column("ids").combine_chunks()
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy().tolist()
            text, packed = list(map(str, flat.tolist())), flat.astype("<i4").tobytes()
            for i, a, b in zip(got.column("word").to_pylist(), ends[:-1], ends[1:], strict=True):
                self.known[pieces[i]] = (",".join(text[a:b]), packed[4 * a : 4 * b])

    def _long(self, raw: list[bytes], todo: list[int]) -> dict[int, list[int]]:
        """Ids of long pieces, by as many queries as their turns need."""
        out: dict[int, list[int]] = {}
        group = np.cumsum([len(raw[i]) for i in todo]) // LONG_BYTES
        for g in np.unique(group):
            state = {todo[i]: (self.single[np.frombuffer(raw[todo[i]], np.uint8)], np.arange(len(raw[todo[i]]))) for i in np.flatnonzero(group == g)}
            while state:
                turns = max(1, self.gathered // sum(len(t) for t, _ in state.values()))
                self._first(np.repeat(np.array(list(state), np.int64), [len(t) for t, _ in state.values()]), *(np.concatenate(x) for x in zip(*state.values(), strict=True)))
                for word, turn, toks in zip(*(x for x in self.db.sql(ENCODE_LONG.format(reach=self.reach, turns=turns)).to_arrow_table().columns), strict=True):
                    tok, pos = toks.values.field("tok").to_numpy(), toks.values.field("pos").to_numpy()
                    if turn.as_py() < turns:
                        out[word.as_py()] = tok.tolist()
                        del state[word.as_py()]
                    else:
                        state[word.as_py()] = tok, pos
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encodes distinct pieces and keeps (ids as text, ids as bytes)."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short, long = [], []
        for i, b in enumerate(raw):
            if (rank := self.ranks.get(b)) is not None:
                self.known[pieces[i]] = (str(rank), rank.to_bytes(4, "little"))
            elif len(b) >= 1 << 23:
                raise ValueError("a piece of 8 MB and more between two places where the pattern cuts")
            else:
                (long if len(b) > self.reach else short).append(i)
        self._short(pieces, raw, short)
        for i, ids in self._long(raw, long).items():
            self.known[pieces[i]] = (",".join(map(str, ids)), np.array(ids, "<i4").tobytes())

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """Bytes of lists of ids."""
        out = [b""] * len(lists)
        size = np.array([len(x) for x in lists])
        upto = np.cumsum(size)
        for g in np.unique(upto // self.decoded):
            part = np.flatnonzero(upto // self.decoded == g)
            flat = np.concatenate([lists[i] for i in part]) if len(part) else np.zeros(0, np.int64)
            self._table("ids", word=np.repeat(part, size[part]), pos=np.arange(len(flat)), id=flat.astype(np.int64))
            got = self.db.sql(DECODE).to_arrow_table()
            for i, h in zip(got.column("word").to_pylist(), got.column("hex").to_pylist(), strict=True):
                out[i] = bytes.fromhex(h)
        return out

    def encode(self, texts: list[str | None]):
        """For each text: the list of (ids as text, ids as bytes) of its pieces.

        Two generations of pieces are kept, so those in use outlast the rest.
        """
        cut = [self.pieces(t or "") for t in texts]
        known, older = self.known, self.older
        new = []
        for p in set().union(*cut):
            if p not in known:
                if (x := older.get(p)) is None:
                    new.append(p)
                else:
                    known[p] = x
        for lo in range(0, len(new), self.group):
            self.learn(new[lo : lo + self.group])
        get = known.__getitem__
        out = [list(map(get, x)) for x in cut]
        if len(known) > self.keep:
            self.older, self.known = known, {}
        return out


    def rest(self) -> None:
        """Gives back the memory of all pieces, and what the allocators hold beyond need."""
        self.known, self.older = {}, {}
        trim()


def trim() -> None:
    """Returns free memory to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


@lru_cache(1)
def _codec(ranks: bytes, pattern: str, keep: int = KEEP, group: int = GROUP, memory_mb: int = MEMORY_MB) -> Codec:
    return Codec(ranks, pattern, keep, group, memory_mb)


#: Rows that are encoded together; more rows share more pieces, and hold more memory.
TOGETHER_BYTES = 8 << 20


def _ids(pieces: list[tuple[str, bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join([p[1] for p in pieces]), "<i4")


def _run(docs: DataFrame, path: str, pattern: str, rows_of, schema: str, names: list[str], small: bool = False) -> DataFrame:
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:  # a file of fixed size on the driver; the executors get its bytes
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    settings, together = ((KEEP // 6, GROUP // 6, 100), TOGETHER_BYTES // 8) if small else ((KEEP, GROUP, MEMORY_MB), TOGETHER_BYTES)

    def run(batches):
        codec = _codec(sent.value, pattern, *settings)
        for b in gathered(batches, together):
            text = b.column("text")
            if small:  # the stage before repeats documents, and leaves the repeats side by side
                text = text.fill_null("").dictionary_encode()
                once = rows_of(codec, codec.encode(text.dictionary.to_pylist()))
                rows = [once[i] for i in text.indices.to_pylist()]
            else:
                rows = rows_of(codec, codec.encode(text.to_pylist()))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, cols)], names=["doc_id", *names])
            if small:
                trim()
        if small:  # the worker waits for other stages' tasks
            codec.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) as doc_id and ids (array of int); null texts count as empty and have no ids; repeated rows stay."""
    return _run(docs, path, pattern, lambda codec, cut: [(_ids(x).astype(np.int64),) for x in cut], "doc_id long, ids array<long>", ["ids"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows(doc_id, ids) as doc_id and the decoded bytes; null and empty ids give no bytes."""
    small_batches(rows.sparkSession)
    with open(path, "rb") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = _codec(sent.value, "")
        for b in batches:
            got = codec.decode([np.array(x or [], np.int64) for x in b.column("ids").to_pylist()])
            yield pa.record_batch([b.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, small: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the bytes that the row's ids decode to.

    small: workers keep a sixth of the pieces, for more CPU time and less memory, and encode equal texts that
    come together once; the results are the same. Columns but doc_id and text are not read.
    """

    def rows_of(codec, cut):
        lists = [_ids(x) for x in cut]
        texts = [",".join([p[0] for p in x]) for x in cut]
        return [(len(i), hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(d).hexdigest()) for i, t, d in zip(lists, texts, codec.decode(lists), strict=True)]

    return _run(docs, path, pattern, rows_of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], small)


def op9_byte_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every document and their decoding."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def stage_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document's tokens and their decoding.

    Executors still hold what the stages before needed, so the workers' caches are small.
    """
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, small=True)
