"""Problem 7: a public byte-level BPE as a streaming transducer with bounded lookahead.

Text goes in by chunks; token ids come out as soon as nothing that may follow can change them:

* Pieces (the pre-tokenizer's runs) end where the pattern ends them. A piece is final once two more characters are
  known, as the pattern looks ahead that far at most, or at a change from non-space to space.
* Within a piece the merge list decides. ``lookahead`` computes how far to the right a merge can depend on what
  follows: the longest chain of ever earlier merges that each take the end of the one before. Pieces within that are
  encoded whole, longer ones byte by byte: of every prefix only the last token and a back pointer are kept (it is the
  one token that fits its predecessor), and tokens are emitted where the back pointers of all the prefixes that may
  still be extended meet. What is kept is the bytes since the last meeting point.

``Decoder`` is the inverse state machine from ids to text.
"""

from __future__ import annotations

import base64
import codecs
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WHITE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pattern of the byte-level vocabularies, for which a faster form is known.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 18
CACHE = 1 << 18


def default_vocabulary() -> str:
    """The path of ``byte_bpe_50k.tiktoken``; pass another path to use it elsewhere."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: The runs of one class that a piece of the known pattern can be, white space apart.
RUNS = [regex.compile(rf" ?{c}+") for c in (r"\p{L}", r"\p{N}", rf"[^{WHITE}\p{{L}}\p{{N}}]")]


def _same(run: regex.Pattern, held: str, source: Iterator[str], rest: list[str]) -> Iterator[bytes]:
    """The bytes of a run that begins with ``held``, as far as it goes; what follows is left in ``rest``."""
    yield held.encode("utf-8", "surrogatepass")
    for chunk in source:
        m = run.match("x" + chunk if run is RUNS[0] else "1" + chunk if run is RUNS[1] else "!" + chunk)
        n = m.end() - 1
        yield chunk[:n].encode("utf-8", "surrogatepass")
        if n < len(chunk):
            rest[0] = chunk[n:]
            return


class Machine(dict):
    """The transducer of one vocabulary. As a mapping it goes from pieces to their ids, and forgets all when full."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        # The white space of the vocabulary's own library is Unicode's White_Space, without the information separators.
        own = (pattern or default_pattern()).replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")
        self.pieces = self._any = regex.compile(own).findall
        self.known = (pattern or default_pattern()) == KNOWN
        if self.known:  # the same for ASCII only, several times as fast
            ascii_only = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
            self.pieces = lambda text: ascii_only(text) if text.isascii() else self._any(text)
        self.edges = regex.compile(rf"(?r)(?<=[^{WHITE}])(?=[{WHITE}])")
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.lookahead = self._lookahead()

    # --- the merge list

    def _parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The merge that makes ``token``: its encoding with only the merges before it."""
        parts = self._merge(token, self.ranks[token])
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _merge(self, data: bytes, below: int = sys.maxsize) -> list[bytes]:
        """``data`` by the definition: always the first pair of the earliest merge."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], below) for i in range(len(data) - 1)]
        while pairs and (r := min(pairs)) < below:
            i = pairs.index(r)
            token = parts[i] + parts[i + 1]
            parts[i : i + 2] = [token]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + token, below)
            if i < len(pairs):
                pairs[i] = ranks.get(token + parts[i + 1], below)
        return parts

    def _lookahead(self) -> int:
        """Bytes to the right of a merge on which it can depend."""
        reach: dict[bytes, int] = {}
        rights: dict[bytes, bytes] = {}
        most = 0
        for token in sorted(self.ranks, key=self.ranks.__getitem__):
            if len(token) == 1:
                continue
            # The split with the two latest-made halves that exist suffices for a bound, and needs no merging.
            cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks and max(self.ranks[token[:i]], self.ranks[token[i:]]) < self.ranks[token]]
            if not cuts:
                continue
            here = 0
            for left, right in cuts:
                spine, far = right, 0
                while spine is not None:
                    far = max(far, reach.get(spine, 0))
                    spine = rights.get(spine)
                here = max(here, len(token) + far)
                reach[left] = max(reach.get(left, 0), len(token) + far)
                rights[token] = right
            most = max(most, here)
        return most

    # --- pieces

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        if data in self.ranks:
            ids: tuple[int, ...] = (self.ranks[data],)
        elif len(data) <= self.lookahead:
            ids = tuple(self.ranks[x] for x in self._merge(data))
            if len(data) > 128:
                return ids
        else:
            return tuple(self.stream(data[i : i + CHUNK] for i in range(0, len(data), CHUNK)))
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids

    def _fit(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay next to each other when their text is encoded alone."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self.fits[key] = self._merge(left + right) == [left, right]
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes by chunks of bytes, emitted once stable."""
        kept = bytearray()  # the bytes since the last meeting point
        last: list[bytes | None] = [None]  # the last token of each prefix of them
        base: bytes | None = None  # the token before them
        seen = 0
        for data in chunks:
            kept += data
            while seen < len(kept):
                seen += 1
                text = bytes(kept[max(0, seen - self.longest) : seen])
                for n in range(min(self.longest, seen), 0, -1):
                    token = text[-n:]
                    if token in self.ranks:
                        before = last[seen - n] if seen > n else base
                        if before is None and seen > n:
                            continue
                        if before is None or self._fit(before, token):
                            last.append(token)
                            break
                else:
                    last.append(None)  # no encoding ends here
                if seen % 256 == 0 and seen > 2 * self.longest:
                    meet = self._meeting(last, seen)
                    if meet > 0:
                        out = self._back(last, meet)
                        yield from (self.ranks[x] for x in out)
                        base = out[-1]
                        del kept[:meet]
                        last = [None, *last[meet + 1 :]]
                        seen -= meet
        if seen:
            yield from (self.ranks[x] for x in self._back(last, seen))

    def _meeting(self, last: list[bytes | None], seen: int) -> int:
        """The furthest position that the encodings of all prefixes which may still be extended share."""
        live = {i for i in range(max(0, seen - self.longest + 1), seen + 1) if i == 0 or last[i] is not None}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - len(last[far]))  # type: ignore[arg-type]
        return live.pop()

    @staticmethod
    def _back(last: list[bytes | None], at: int) -> list[bytes]:
        out = []
        while at > 0:
            token = last[at]
            assert token is not None
            out.append(token)
            at -= len(token)
        return out[::-1]

    # --- text

    def transduce(self, chunks: Iterable[str]) -> Iterator[array]:
        """Arrays of ids for a text that comes by chunks; what is held is what no boundary closes yet.

        A run of one class (letters, digits, other signs) that outgrows a chunk is handed on to ``stream`` as it comes, so
        it takes no memory of its own either. Runs of white space are held, as what follows decides how they end.
        """
        source = iter(chunks)
        held = ""
        for chunk in source:
            held += chunk
            if len(held) < CHUNK:
                continue
            m = self.edges.search(held)  # the last one
            cut = m.start() if m else 0
            if not cut:
                found = self.pieces(held)
                done = len(held) - len(found[-1])
                while found and done + len(found[-1]) + 2 > len(held):
                    cut = done
                    found.pop()
                    done -= len(found[-1]) if found else 0
            if cut:
                yield array("i", chain.from_iterable(map(self.__getitem__, self.pieces(held[:cut]))))
                held = held[cut:]
            elif self.known and (run := next((r for r in RUNS if r.fullmatch(held)), None)):
                rest = [""]
                part = array("i")
                for i in self.stream(_same(run, held, source, rest)):
                    part.append(i)
                    if len(part) >= CHUNK:
                        yield part
                        part = array("i")
                yield part
                held = rest[0]
        if held:
            yield array("i", chain.from_iterable(map(self.__getitem__, self.pieces(held))))

    def encode(self, text: str | None) -> array:
        """All ids of a text, without special tokens; none for an empty or null text."""
        if not text:
            return array("i")
        if len(text) <= CHUNK:
            return array("i", chain.from_iterable(map(self.__getitem__, self.pieces(text))))
        out = array("i")
        for part in self.transduce(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)):
            out.extend(part)
        return out


class Decoder:
    """Ids to text, piece by piece; bytes of an unfinished character wait for the next id."""

    def __init__(self, machine: Machine) -> None:
        self.tokens = machine.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("surrogatepass")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(self.tokens[i] for i in ids), final)


_MACHINES: dict[tuple[str, str | None], Machine] = {}


def machine(path: str, pattern: str | None = None) -> Machine:
    """The machine of a vocabulary, one a process."""
    if (path, pattern) not in _MACHINES:
        _MACHINES[path, pattern] = Machine(path, pattern)
    return _MACHINES[path, pattern]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the ids of every text, an empty list for empty and null texts. No shuffle; rows keep their partition."""
    path = path or default_vocabulary()
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        from graphloom.llm.bpe import machine as get

        m = get(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                ids = [m.encode(t) for t in texts.slice(at, 256).to_pylist()]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = array("i")
                for x in ids:
                    flat.extend(x)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), lists], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens) of every text, 0 for empty and null ones."""
    path = path or default_vocabulary()
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        from graphloom.llm.bpe import machine as get

        m = get(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m.encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, text): the text of every list of ids, decoded id by id; empty for empty and null lists. Bytes that no
    character makes up come out as the tokenizer's texts had them."""
    path = path or default_vocabulary()
    schema = T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        from graphloom.llm.bpe import Decoder
        from graphloom.llm.bpe import machine as get

        m = get(path, pattern)
        for batch in batches:
            out = []
            for row in batch.column(1):
                d = Decoder(m)
                out.append("".join(d.feed((i.as_py(),)) for i in row.values) + d.feed((), final=True) if row.is_valid else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, schema)
