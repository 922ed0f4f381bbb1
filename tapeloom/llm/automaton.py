"""Secret scans: one deterministic automaton for all rules.

Rule patterns are compiled by subset construction and minimised into one transition array over byte classes.
A buffer of many documents is cut into equal lanes that step together, so all rules are matched in one pass
over the bytes. A lane starts as if nothing had been matched before it; lanes for which that was wrong are
stepped again from the state their predecessor ended in, until they meet the recorded states.

Documents in which a rule accepts get exact leftmost-longest spans from that rule's own two automata: a
backward one, stepped over lanes as well, that marks every position where a match can start, and a forward one
that goes from a start to the match's end. Time and memory are in proportion to a text's length.

Defined results: a null or empty text has no span; equal texts have equal spans; columns other than the id and
the text are ignored, whatever their names. Offsets are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.textbuf import flat, slices

#: Not a byte of UTF-8, so it can part documents.
SEPARATOR = 255
LANES = 4096
#: Bytes that are stepped at once; the state is carried on to the next ones.
BLOCK = 4 << 20


@dataclass(frozen=True)
class Rule:
    """min_length counts what follows the last occurrence of `after` in a match, or the whole match."""

    name: str
    pattern: str
    min_length: int = 0
    after: str = ""


# The base kinds of the secret scan.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, "value"),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE_RULES + EXTRA_RULES


class Nfa:
    """Thompson fragments: `edges` go from a state on a set of bytes, `free` on nothing."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def copy_of(self, node, reverse: bool) -> tuple[int, int]:
        """The entry and exit of a new fragment for a parsed node."""
        kind = node[0]
        a, b = self.state(), self.state()
        if kind == "set":
            self.edges[a].append((node[1], b))
        elif kind == "cat":
            at = a
            for part in reversed(node[1]) if reverse else node[1]:
                x, y = self.copy_of(part, reverse)
                self.free[at].append(x)
                at = y
            self.free[at].append(b)
        elif kind == "alt":
            for part in node[1]:
                x, y = self.copy_of(part, reverse)
                self.free[a].append(x)
                self.free[y].append(b)
        else:
            _, part, least, most = node
            at = a
            for _ in range(least):
                x, y = self.copy_of(part, reverse)
                self.free[at].append(x)
                at = y
            if most is None:
                x, y = self.copy_of(part, reverse)
                self.free[at] += [x, b]
                self.free[y] += [x, b]
            else:
                for _ in range(most - least):
                    x, y = self.copy_of(part, reverse)
                    self.free[at] += [x, b]
                    at = y
                self.free[at].append(b)
        return a, b

    def closure(self, states) -> frozenset[int]:
        todo = list(states)
        seen = set(todo)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Pattern:
    """Recursive descent over literals, classes, escapes, groups, alternation and quantifiers, as bytes."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.node = self.alternatives(False)
        if self.at != len(text):
            raise ValueError(f"unbalanced parenthesis in {text!r}")

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self, fold: bool):
        parts = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence(fold))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self, fold: bool):
        parts = []
        while self.peek() not in ("", "|", ")"):
            node = self.atom(fold)
            while self.peek() in ("*", "+", "?", "{") and self.peek():
                node = ("rep", node, *self.bounds())
            parts.append(node)
        return ("cat", parts)

    def bounds(self) -> tuple[int, int | None]:
        mark = self.take()
        if mark != "{":
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[mark]
        inside = self.text[self.at : self.text.index("}", self.at)]
        self.at += len(inside) + 1
        low, comma, high = inside.partition(",")
        return int(low), int(high) if high else None if comma else int(low)

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.text.startswith("?i:", self.at):
                self.at, fold = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            node = self.alternatives(fold)
            if self.take() != ")":
                raise ValueError(f"unbalanced parenthesis in {self.text!r}")
            return node
        if c == "[":
            return ("set", self.folded(self.members(), fold))
        if c == ".":
            return ("set", frozenset(set(range(SEPARATOR)) - {10}))
        if c == "\\":
            return ("set", self.folded(self.escape(), fold))
        units = [("set", self.folded(frozenset([x]), fold)) for x in c.encode()]
        return units[0] if len(units) == 1 else ("cat", units)

    def escape(self) -> frozenset[int]:
        c = self.take()
        if c == "x":
            self.at += 2
            return frozenset([int(self.text[self.at - 2 : self.at], 16)])
        named = {"d": range(48, 58), "n": [10], "t": [9], "r": [13], "s": [32, *range(9, 14)], "w": [*range(48, 58), *range(65, 91), 95, *range(97, 123)]}
        return frozenset(named[c] if c in named else [ord(c)])

    def members(self) -> frozenset[int]:
        negated, out = self.peek() == "^", set()
        self.at += negated
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else frozenset([ord(c)])
            if self.peek() == "-" and self.text[self.at + 1] != "]" and len(low) == 1:
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else frozenset([ord(c)])
                out |= set(range(min(low), max(high) + 1))
            else:
                out |= low
        self.take()
        return frozenset(set(range(SEPARATOR)) - out if negated else out)

    @staticmethod
    def folded(units: frozenset[int], fold: bool) -> frozenset[int]:
        return units | {x ^ 32 for x in units if chr(x).isascii() and chr(x).isalpha()} if fold else units


def shortest(node):
    """The node with the repetition at its end cut to the least count: it matches somewhere just where the node does."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], shortest(node[1][-1])])
    return ("rep", node[1], node[2], node[2]) if node[0] == "rep" else node


@dataclass
class Dfa:
    """next_[state, byte class]; accepts[state] is a bit set of rules; state 0 is the start."""

    next_: np.ndarray
    classes: np.ndarray
    accepts: np.ndarray

    @property
    def dead(self) -> np.ndarray:
        """States that no input leaves, and that accept nothing."""
        own = np.arange(len(self.next_))
        return (self.next_ == own[:, None]).all(1) & (self.accepts == 0)


def determinise(nodes: list, search: bool, reverse: bool = False) -> Dfa:
    """Subset construction over byte classes, then minimisation by refining the partition of states.

    search: a match may start anywhere, and a separator byte starts anew.
    """
    nfa = Nfa()
    fragments = [nfa.copy_of(node, reverse) for node in nodes]
    final = {b: 1 << i for i, (_, b) in enumerate(fragments)}
    used = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
    signature = np.zeros((256, len(used)), bool)
    for i, s in enumerate(used):
        signature[list(s), i] = True
    _, classes = np.unique(signature, axis=0, return_inverse=True)
    classes = classes.reshape(-1).astype(np.uint8)
    member = {int(c): int(np.flatnonzero(classes == c)[0]) for c in np.unique(classes)}
    start = nfa.closure(a for a, _ in fragments)
    ids, rows, todo = {start: 0}, [], [start]
    for states in todo:
        row = []
        for c in sorted(member):
            to = nfa.closure(t for s in states for on, t in nfa.edges[s] if member[c] in on)
            to = to | start if search else to
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum({final[s] for s in states if s in final}) for states in todo], np.int64)
    block = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, len(block))
    np.minimum.at(order, block, np.arange(len(block)))
    keep = np.sort(order)
    name = np.searchsorted(keep, order[block])
    return Dfa(name[table[keep]].astype(np.uint16), classes, accepts[keep])


class Lanes:
    """An automaton for searches, stepped over many lanes of a buffer at once."""

    def __init__(self, dfa: Dfa):
        self.classes, self.accepts, self.width = dfa.classes, dfa.accepts, dfa.next_.shape[1]
        # states are kept premultiplied by the row width, so that a step is one addition and one lookup
        self.step = (dfa.next_.astype(np.intp) * self.width).reshape(-1)
        self.flag = np.repeat(dfa.accepts != 0, self.width)

    def accepting(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the automaton accepts after a byte, and its rules there as bits."""
        at, bits, state = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for lo in range(0, len(data), BLOCK):
            places, accepts, state = self._block(data[lo : lo + BLOCK], state)
            at.append(places + lo)
            bits.append(accepts)
        return np.concatenate(at), np.concatenate(bits)

    def _block(self, data: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, int]:
        lanes = max(1, min(LANES, len(data) // 64))
        length = -(-len(data) // lanes)
        padded = np.full(lanes * length, SEPARATOR, np.uint8)
        padded[: len(data)] = data
        grid = np.ascontiguousarray(self.classes[padded].reshape(lanes, length).T)
        out = np.empty((length, lanes), np.intp)
        state, index = np.zeros(lanes, np.intp), np.empty(lanes, np.intp)
        state[0] = first
        enter = state.copy()
        for t in range(length):
            np.add(state, grid[t], out=index)
            state = np.take(self.step, index, out=out[t], mode="clip")
        while True:
            came = np.concatenate([np.array([first], np.intp), out[-1, :-1]])
            lane = np.flatnonzero(came != enter)
            if not len(lane):
                break
            enter[lane] = came[lane]
            state = came[lane]
            for t in range(length):
                state = self.step[state + grid[t, lane]]
                differs = state != out[t, lane]
                lane, state = lane[differs], state[differs]
                if not len(lane):
                    break
                out[t, lane] = state
        step, lane = np.nonzero(np.take(self.flag, out, mode="clip"))
        at = lane * length + step
        order = np.argsort(at)
        order = order[at[order] < len(data)]
        end = len(data) - 1
        return at[order], self.accepts[out[step, lane][order] // self.width], int(out[end % length, end // length])


def parted(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The rows with a separator after each."""
    joined = np.full(len(data) + len(offs) - 1, SEPARATOR, np.uint8)
    own = np.ones(len(joined), bool)
    own[offs[1:] + np.arange(len(offs) - 1)] = False
    joined[own] = data
    return joined


class Scanner:
    """The combined automaton of some rules, and each rule's own pair for exact spans."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nodes = [Pattern(r.pattern).node for r in rules]
        self.all = Lanes(determinise([shortest(x) for x in nodes], search=True))
        self.starts = [Lanes(determinise([x], search=True, reverse=True)) for x in nodes]
        self.ends = [determinise([x], search=False) for x in nodes]

    def hits(self, data: np.ndarray, offs: np.ndarray) -> dict[int, int]:
        """Rows in which some rule accepts, with the bit set of those rules; one pass over the bytes."""
        at, accepts = self.all.accepting(parted(data, offs))
        found: dict[int, int] = {}
        if len(at):
            row = np.searchsorted(offs[1:] + np.arange(len(offs) - 1), at, "right")
            pairs = np.unique(np.column_stack([row, accepts]), axis=0)
            for r, bits in pairs.tolist():
                found[r] = found.get(r, 0) | bits
        return found

    def spans(self, data: np.ndarray, offs: np.ndarray, hits: dict[int, int]) -> dict[int, list[tuple[int, int, int]]]:
        """By row: (start, end, rule) in code points, leftmost-longest and non-overlapping within a rule, by start and rule."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, rule in enumerate(self.rules):
            rows = [r for r, bits in sorted(hits.items()) if bits >> k & 1]
            if not rows:
                continue
            sizes = [int(offs[r + 1] - offs[r]) for r in rows]
            bounds = np.cumsum([0, *sizes])
            text = np.concatenate([data[offs[r] : offs[r + 1]] for r in rows])
            # backward over all of these rows at once
            joined = parted(text, bounds)
            begins = len(joined) - 1 - self.starts[k].accepting(joined[::-1])[0][::-1]
            row = np.searchsorted(bounds[1:] + np.arange(len(rows)), begins, "right")
            cuts = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
            for i, r in enumerate(rows):
                own = text[bounds[i] : bounds[i + 1]]
                matches = self._longest(k, own.tobytes(), (begins[cuts[i] : cuts[i + 1]] - bounds[i] - i).tolist())
                if matches:
                    found.setdefault(r, []).extend((a, b, k) for a, b in matches)
        out = {}
        for r, spans in found.items():
            own = data[offs[r] : offs[r + 1]]
            # code points before each byte: continuation bytes don't count
            points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80, dtype=np.int32)])
            out[r] = sorted(((int(points[a]), int(points[b]), k) for a, b, k in spans), key=lambda s: (s[0], s[2]))
        return out

    def _longest(self, k: int, text: bytes, begins: list[int]) -> list[tuple[int, int]]:
        rule, ahead = self.rules[k], self.ends[k]
        table, accept, dead, classes = ahead.next_.tolist(), ahead.accepts.tolist(), ahead.dead.tolist(), ahead.classes.tolist()
        done, out = 0, []
        for i in begins:
            if i < done:
                continue
            state, end, j = 0, 0, i
            while j < len(text):
                state = table[state][classes[text[j]]]
                j += 1
                if accept[state]:
                    end = j
                elif dead[state]:
                    break
            done = end
            if self.value_length(rule, text[i:end]) >= rule.min_length:
                out.append((i, end))
        return out

    @staticmethod
    def value_length(rule: Rule, match: bytes) -> int:
        """Code points of the match, or of its value: what follows the first mark of assignment, blanks and a quote."""
        if rule.after != "value":
            return len(match.decode())
        mark = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
        rest = match[mark + 1 :].lstrip(b" ")
        return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _named(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].name}:{a}:{b}" for a, b, k in spans)


SCAN_SCHEMA = "id long, spans array<struct<kind:string,start:int,end:int>>"
DIGEST_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_column(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> Iterator[tuple[int, int, dict[int, list[tuple[int, int, int]]]]]:
    """(first row, end row, spans by row) for slices of whole rows."""
    scan = scanner(rules)
    for lo, hi, data, offs in slices(column, 4 << 20):
        yield lo, hi, {lo + r: s for r, s in scan.spans(data, offs, scan.hits(data, offs)).items()}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row's secret spans by kind, as an array ordered by start and rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in scan_column(flat(batch.column(1)), rules):
                spans = [[{"kind": rules[k].name, "start": a, "end": b} for a, b, k in found.get(r, ())] for r in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(spans, _SPAN)], names=["id", "spans"])

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).mapInArrow(run, SCAN_SCHEMA)


def scan_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and a digest of the base kinds' spans, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for lo, hi, found in scan_column(flat(batch.column(1))):
                counts = np.zeros((3, hi - lo), np.int64)
                digests, said = [none] * (hi - lo), [""] * (hi - lo)
                for r, spans in found.items():
                    base = [s for s in spans if s[2] < len(BASE_RULES)]
                    for s in base:
                        counts[s[2], r - lo] += 1
                    digests[r - lo] = hashlib.sha256(_named(base, RULES).encode()).hexdigest()
                    said[r - lo] = _named(spans, RULES)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(pa.array(c) for c in counts), pa.array(digests), pa.array(said)], names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, DIGEST_SCHEMA)


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with each span's text replaced by [kind], overlapping spans as one, and the length column brought up to date.

    A null text stays null. All other columns pass as they are.
    """
    schema, at = df.schema, df.columns.index(text_col)
    length = df.columns.index(length_col) if length_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            changed = {}
            for _, _, found in scan_column(flat(column)):
                for r, spans in found.items():
                    text, out, done = column[r].as_py(), [], 0
                    for a, b, k in spans:
                        if a >= done:
                            out += [text[done:a], f"[{RULES[k].name}]"]
                        done = max(done, b)
                    changed[r] = "".join(out) + text[done:]
            if changed:
                values = column.to_pylist()
                for r, text in changed.items():
                    values[r] = text
                columns = list(batch.columns)
                columns[at] = pa.array(values, column.type)
                if length is not None:
                    sizes = columns[length].to_pylist()
                    for r, text in changed.items():
                        sizes[r] = len(text)
                    columns[length] = pa.array(sizes, columns[length].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return df.mapInArrow(run, schema)
