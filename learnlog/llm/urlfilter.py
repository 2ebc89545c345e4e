"""URL rules: glob patterns packed into multiword Shift-And masks, all simulated at once over each
canonical URL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.llm.common import prepared, slices, text_bytes
from learnlog.sources.tables import read_table

#: Bytes that the masks of one rule list may take; the rules are a parameter, not data.
MOST_MASK_BYTES = 64 << 20
#: Words of state that one numpy pass keeps.
STATE_WORDS = 1 << 20
#: Steps between two looks at which URLs are decided.
_LOOK = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host/path: it fits the host and all its subdomains, where the URL's path starts
    with the rule's (from the first slash on). In it, ``*`` is any run of characters (of the host's, before
    that slash), ``?`` any one character, and a backslash takes the next character as it stands. A pattern
    without a slash fits every path."""

    pattern: str
    verdict: str


#: The rules of the registered query.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"),
         Rule("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _steps(pattern: str) -> list[tuple[str, bytes]]:
    """The rule as (kind, bytes): ``byte`` one of these, ``loop`` any number of these."""
    other = bytes(range(256))
    lead = bytes(b for b in other if not 0x80 <= b < 0xC0)
    more = bytes(range(0x80, 0xC0))
    in_host = bytes(b for b in other if b != ord("/"))
    # canonical form: a dot, the host, the path; so a rule's host follows a dot, whatever is before it
    out, host, at = [("loop", in_host), ("byte", b".")], True, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            out.append(("loop", in_host if host else other))
        elif c == "?":
            out += [("byte", bytes(b for b in lead if not (host and b == ord("/")))), ("loop", more)]
        else:
            if c == "\\" and at + 1 < len(pattern):
                at += 1
                c = pattern[at]
            c = c.translate(str.maketrans(_UPPER, _LOWER)) if host else c
            host = host and c != "/"
            out += [("byte", bytes([b])) for b in c.encode("utf-8", "surrogatepass")]
        at += 1
    # a rule without a path may end where the host does, or go on with any path
    return [*out, *[("end", b""), ("byte", b"/")][:2 * host], ("loop", other)]


@dataclass
class Automaton:
    """Bit j of the state is set while some rule's first steps up to its own j-th are matched. Rules lie
    behind one another in the order in which they win, so the lowest accepting bit is the answer."""

    rules: list
    move: np.ndarray    # 256 x words: bits that may be entered from the bit below on this byte
    stay: np.ndarray    # 256 x words: bits that may be kept on this byte
    first: np.ndarray   # words: each rule's first bit
    skip: np.ndarray    # words: bits entered from the bit below without a byte (loops of length 0)
    accept: np.ndarray  # words: each rule's last bit, and where it may end
    sticky: np.ndarray  # words: the accepting bits that nothing can clear
    of_bit: np.ndarray  # rule per bit
    runs: int           # how often ``skip`` must be applied

    @classmethod
    def build(cls, rules: Sequence[Rule]) -> Automaton:
        """Longer patterns win, then those with the longer host, then the earlier."""
        order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].pattern), -len(rules[i].pattern.split("/")[0]), i))
        steps = [_steps(rules[i].pattern) for i in order]
        # bit 0 of a rule: nothing read yet; then one bit per step
        bits = sum(1 + len([s for s in p if s[0] != "end"]) for p in steps)
        words = max(1, -(-bits // 64))
        if 2 * 256 * words * 8 > MOST_MASK_BYTES:
            raise ValueError(f"the rules need {bits} states; masks of at most {MOST_MASK_BYTES} bytes are kept")
        move, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        first, skip, accept, sticky = (np.zeros(words, np.uint64) for _ in range(4))
        of_bit = np.zeros(words * 64, np.int64)

        def put(mask: np.ndarray, bit: int) -> None:
            mask[..., bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

        bit, runs = 0, 0
        for rank, p in enumerate(steps):
            put(first, bit)
            of_bit[bit] = rank
            run = 0
            for kind, accepts in p:
                if kind == "end":
                    put(accept, bit)
                    continue
                bit += 1
                of_bit[bit] = rank
                here = np.zeros(256, bool)
                here[list(accepts)] = True
                if kind == "byte":
                    rows = move[here]
                    put(rows, bit)
                    move[here] = rows
                    run = 0
                else:
                    rows = stay[here]
                    put(rows, bit)
                    stay[here] = rows
                    put(skip, bit)
                    run += 1
                    runs = max(runs, run)
            put(accept, bit)
            put(sticky, bit)
            bit += 1
        return cls([rules[i] for i in order], move, stay, first, skip, accept, sticky, of_bit, runs)

    @staticmethod
    def _shift(state: np.ndarray) -> np.ndarray:
        """All bits one up, over the words' borders."""
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out

    def _skipped(self, state: np.ndarray) -> np.ndarray:
        for _ in range(self.runs):
            state |= self._shift(state) & self.skip
        return state

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Place in ``rules`` of the winning rule of every text (the bytes between two offsets), or -1."""
        n = len(offsets) - 1
        out = np.full(n, -1, np.int64)
        if not n or not self.rules:
            return out
        length = np.diff(offsets)
        live = np.argsort(-length, kind="stable")  # longest first: who has ended is at the back
        state = self._skipped(np.repeat(self.first[None, :], n, axis=0))
        i = 0
        while len(live):
            going = int(np.searchsorted(-length[live], -i, side="left"))  # those longer than i
            if going < len(live):
                self._settle(out, live[going:], state[going:])
                live, state = live[:going], state[:going]
                continue
            byte = data[offsets[live] + i]
            state = self._skipped((self._shift(state) & self.move[byte]) | (state & self.stay[byte]))
            i += 1
            if i % _LOOK == 0:
                # decided: only rules that stay accepted are left
                done = ~(state & ~self.sticky).any(axis=1)
                if done.any():
                    self._settle(out, live[done], state[done])
                    live, state = live[~done], state[~done]
        return out

    def _settle(self, out: np.ndarray, rows: np.ndarray, state: np.ndarray) -> None:
        hit = state & self.accept
        word = (hit != 0).argmax(axis=1)
        value = hit[np.arange(len(rows)), word]
        some = value != 0
        low = value & (~value + np.uint64(1))
        bit = np.zeros(len(rows), np.int64)
        bit[some] = np.log2(low[some].astype(np.float64)).astype(np.int64)  # powers of two: exact
        out[rows] = np.where(some, self.of_bit[word * 64 + bit], -1)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (the pattern; null if none fits), verdict.

    The canonical URL is the host in lower case and the path without query and fragment. Of the rules
    that fit the longest wins (equally long: the longer host, then the earlier in the list);
    without one the verdict is ``default``. Null URLs and those without ``://`` have an empty host and
    path, which no rule with a host fits. Very long URLs are read whole; they end early once no
    rule can change. Ids may be null or repeated (each row is judged), other columns are ignored
    whatever their names, an empty table gives no rows, an empty rule list fits nothing. Ports and user
    names belong to the host as it stands."""
    prepared(pages.sparkSession)
    automaton = Automaton.build(list(rules))
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = pa.array([r.pattern for r in automaton.rules], pa.string())
        verdicts = pa.array([*[r.verdict for r in automaton.rules], default], pa.string())
        most = max(64, STATE_WORDS // len(automaton.first))
        for batch in batches:
            for part in slices(batch.select(["id", "host", "path", "text"]), "text", rows=most):
                rule = automaton.match(*text_bytes(part.column("text")))
                taken = pa.array(rule, mask=rule < 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("host"), part.column("path"), patterns.take(taken),
                     verdicts.take(pa.array(np.where(rule < 0, len(automaton.rules), rule)))],
                    ["id", "host", "path", "rule", "verdict"])

    return (rows.withColumn("text", F.concat(F.lit("."), "host", "path"))
            .mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
            .withColumnRenamed("id", id_col))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by ``RULES``."""
    return judge(read_table(spark, sf_dir, "pages"))


_ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a
           FROM pages),
u AS (SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
           arg_max(r.verdict, length(r.host || r.path)) AS verdict
         FROM (SELECT DISTINCT host, path FROM u) u JOIN rules r
           ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
         GROUP BY u.host, u.path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fits USING (host, path)"""

QUERIES = {"op11_urls": op11_urls}
ORACLE = {"op11_urls": _ORACLE}
