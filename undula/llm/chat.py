"""Chat formatting by a template compiler.

A template in a small sandboxed language is cut into tokens, parsed into a syntax tree, its constant parts are folded, and the
tree becomes Python closures. They render a conversation as pieces of text, each marked as generated (under the loss) or not.
The language has no calls, no attributes but keys of the given values, and loops over given lists only.

  {{ e }}   {% if e %} {% elif e %} {% else %} {% endif %}   {% for x in e %} {% endfor %}   {% set x = e %}
  {% generation %} {% endgeneration %}   {# comment #}
  e: 'text' 12 true false none, x, x.key, x['key'], not, and, or, == != < <= > >= in, + (numbers), ~ (texts), (e),
     e | upper, lower, trim, length, escape, default('text'); in a loop: loop.index, loop.first, loop.last
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS = "{% for m in messages %}<turn {{ m.role | escape }}>\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
_OPEN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>\n", re.DOTALL)
_INSIDE = re.compile(r"(?:[^\\<]++|\\.)*+", re.DOTALL)
_CLOSE = "</turn>\n"
#: Characters of a rendered part, about: a conversation's text is a sequence of parts.
PART = 1 << 18


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Text in which no control string of the turn format is left; reversed by unescape()."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable] = {
    "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "trim": lambda v: _text(v).strip(), "escape": lambda v: escape(_text(v)),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else 0, "default": lambda v, other="": other if v is None else v,
}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else ""


# --- tokens and syntax tree: nodes are tuples (kind, ...) ---

_QUOTED = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""
#: An expression or a statement ends at the first mark outside quotes, or, where a quote isn't closed, at the first mark.
_PART = re.compile(rf"\{{\{{((?:{_QUOTED}|(?!\}}\}})[^'\"])*+(?=\}}\}})|.*?)\}}\}}|\{{%((?:{_QUOTED}|(?!%\}})[^'\"])*+(?=%\}})|.*?)%\}}|\{{#.*?#\}}", re.DOTALL)
#: Brackets and negations within each other, and open statements, at most.
DEPTH = 64
#: Operators of an expression, at most.
LINKS = 200
_LEX = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.,()\[\]]))")


def _lex(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        number, string, name, sign = m.groups()
        out.append(("number", float(number) if "." in number else int(number)) if number else ("text", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), string[1:-1], flags=re.DOTALL)) if string else ("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent, loosest first: or, and, not, comparison, + and ~, filters, keys."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth, self.links = _lex(source), 0, 0, 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def within(self, read: Callable[[], tuple]) -> tuple:
        """What is read one level deeper."""
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError(f"more than {DEPTH} levels")
        node = read()
        self.depth -= 1
        return node

    def chained(self, node: tuple) -> tuple:
        """The node, if operators upon operators don't make it too deep a tree."""
        self.links += 1
        if self.links > LINKS:
            raise TemplateError(f"more than {LINKS} operators in an expression")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = self.chained(("or", node, self.both()))
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = self.chained(("and", node, self.negated()))
        return node

    def negated(self) -> tuple:
        return ("not", self.within(self.negated)) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = self.chained(("compare", sign, node, self.added()))
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while sign := self.take("+", "~"):
            node = self.chained(("join" if sign == "~" else "add", node, self.filtered()))
        return node

    def filtered(self) -> tuple:
        node = self.keyed()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            args = []
            if self.take("("):
                args = [self.within(self.either)]
                self.need(")")
            node = self.chained(("filter", name, node, *args))
        return node

    def keyed(self) -> tuple:
        node = self.atom()
        while True:
            if self.take("."):
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1].startswith("_"):
                    raise TemplateError("a key is missing, or isn't allowed")
                node = self.chained(("key", node, ("value", self.tokens[self.at][1])))
                self.at += 1
            elif self.take("["):
                node = self.chained(("key", node, self.within(self.either)))
                self.need("]")
            else:
                return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        if self.take("("):
            node = self.within(self.either)
            self.need(")")
            return node
        kind, value = self.tokens[self.at]
        if kind == "sign":
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        if kind in ("number", "text"):
            return ("value", value)
        fixed = {"true": True, "false": False, "none": None}
        if value.startswith("_"):
            raise TemplateError(f"{value!r} isn't allowed")
        return ("value", fixed[value]) if value in fixed else ("name", value)


def parse(source: str) -> tuple:
    """The syntax tree of a template: ('block', nodes)."""
    top: list = []
    stack: list[tuple[str, list, Any]] = [("block", top, None)]
    at = 0

    def close(kind: str) -> tuple:
        if len(stack) < 2 or stack[-1][0] != kind:
            raise TemplateError(f"no open {kind} to end")
        return stack.pop()

    for m in _PART.finditer(source):
        if m.start() > at:
            stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if len(stack) > DEPTH:
            raise TemplateError(f"more than {DEPTH} open statements")
        if m[1] is not None:
            stack[-1][1].append(("emit", _Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word == "if":
                body = []
                stack.append(("if", body, [[(_Expression(rest).whole(), body)], None]))
            elif word in ("elif", "else"):
                kind, _, state = stack[-1]
                if kind != "if" or state[1] is not None:
                    raise TemplateError(f"{word} outside an if")
                body = []
                if word == "elif":
                    state[0].append((_Expression(rest).whole(), body))
                else:
                    state[1] = body
                stack[-1] = ("if", body, state)
            elif word == "endif":
                _, _, state = close("if")
                stack[-1][1].append(("if", [(c, ("block", b)) for c, b in state[0]], ("block", state[1] or [])))
            elif word == "for":
                name, _, of = rest.strip().partition(" in ")
                if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"can't loop over {rest!r}")
                stack.append(("for", [], (name.strip(), _Expression(of).whole())))
            elif word == "endfor":
                _, body, (name, of) = close("for")
                stack[-1][1].append(("for", name, of, ("block", body)))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"can't set {rest!r}")
                stack[-1][1].append(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                stack.append(("generation", [], None))
            elif word == "endgeneration":
                body = close("generation")[1]
                stack[-1][1].append(("generation", ("block", body)))
            else:
                raise TemplateError(f"no statement {word!r}")
    if at < len(source):
        stack[-1][1].append(("text", source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't ended")
    return ("block", top)


def fold(node: tuple) -> tuple:
    """The tree with constant expressions evaluated, constant branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind == "block":
        out: list = []
        for n in map(fold, node[1]):
            for one in n[1] if n[0] == "block" else [n]:
                if one[0] == "emit" and one[1][0] == "value":
                    one = ("text", _text(one[1][1]))
                if one[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + one[1])
                elif one != ("text", ""):
                    out.append(one)
        return ("block", out)
    if kind == "emit":
        return ("emit", fold(node[1]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        left = []
        for condition, body in node[1]:
            condition = fold(condition)
            if condition[0] == "value":
                if condition[1]:
                    return ("if", left, fold(body)) if left else fold(body)
                continue
            left.append((condition, fold(body)))
        return ("if", left, fold(node[2])) if left else fold(node[2])
    if kind in ("value", "name", "text"):
        return node
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if all(x[0] == "value" for x in parts[1:] if isinstance(x, tuple)):
        return ("value", _expression(parts)({}))
    return parts


# --- closures ---


def _compare(sign: str, a: Any, b: Any) -> bool:
    if sign == "==":
        return a == b
    if sign == "!=":
        return a != b
    if sign == "in":
        return a in b if isinstance(b, (list, tuple, dict)) or isinstance(b, str) and isinstance(a, str) else False
    if type(a) is not type(b) and not all(isinstance(x, (int, float)) for x in (a, b)) or not isinstance(a, (int, float, str)):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


def _add(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, (int, float)) and isinstance(b, (int, float)) else _text(a) + _text(b)


def _expression(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "value":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, k=node[1]: env.get(k)
    if kind == "not":
        a = _expression(node[1])
        return lambda env: not a(env)
    if kind == "compare":
        a, b = _expression(node[2]), _expression(node[3])
        return lambda env, sign=node[1]: _compare(sign, a(env), b(env))
    if kind == "filter":
        a, args, f = _expression(node[2]), [_expression(x) for x in node[3:]], FILTERS[node[1]]
        return lambda env: f(a(env), *[x(env) for x in args])
    a, b = _expression(node[1]), _expression(node[2])
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "join":
        return lambda env: _text(a(env)) + _text(b(env))
    if kind == "add":
        return lambda env: _add(a(env), b(env))

    def key(env: dict) -> Any:  # only keys of dicts and places in lists: nothing else of a value can be reached
        of, k = a(env), b(env)
        return of.get(k) if isinstance(of, dict) else of[k] if isinstance(of, (list, tuple)) and isinstance(k, int) and -len(of) <= k < len(of) else None

    return key


Pieces = Iterator[tuple[str, bool]]


def _statement(node: tuple) -> Callable[[dict, bool], Pieces]:
    kind = node[0]
    if kind == "text":
        return lambda env, gen, t=node[1]: iter(((t, gen),))
    if kind == "emit":
        e = _expression(node[1])
        return lambda env, gen: iter(((_text(e(env)), gen),))
    if kind == "generation":
        body = _statement(node[1])
        return lambda env, gen: body(env, True)
    if kind == "set":
        e = _expression(node[2])

        def put(env: dict, gen: bool, name=node[1]) -> Pieces:
            env[name] = e(env)
            return iter(())

        return put
    if kind == "if":
        branches, other = [(_expression(c), _statement(b)) for c, b in node[1]], _statement(node[2])

        def choose(env: dict, gen: bool) -> Pieces:
            for condition, body in branches:
                if condition(env):
                    return body(env, gen)
            return other(env, gen)

        return choose
    if kind == "for":
        of, body = _expression(node[2]), _statement(node[3])

        def loop(env: dict, gen: bool, name=node[1]) -> Pieces:
            items = of(env)
            items = iter(items) if isinstance(items, (list, tuple, Iterator)) else iter(())
            end = object()
            now, k = next(items, end), 0
            while now is not end:  # one item ahead, so that rows may come one by one
                after, k = next(items, end), k + 1
                yield from body(env | {name: now, "loop": {"index": k, "first": k == 1, "last": after is end}}, gen)
                now = after

        return loop
    body = [_statement(n) for n in node[1]]

    def block(env: dict, gen: bool) -> Pieces:
        for one in body:
            yield from one(env, gen)

    return block


def compile_template(source: str) -> Callable[[dict], Pieces]:
    """render(values) for a template: an iterator of (text, generated)."""
    run = _statement(fold(parse(source)))
    return lambda values: run(dict(values), False)


# --- DataFrames ---

PARTS = "conv_id bigint, part int, text string, spans array<struct<start:int,end:int>>"
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Conversations one after the other, each as an iterator of its turns; rows are drawn as they are used."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")))

    for conv_id, own in groupby(rows(), key=lambda r: r[0]):
        yield conv_id, ({"turn": r[1], "role": r[2] or "", "text": r[3] or ""} for r in own)


def format_conversations(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """(conv_id, part, text, spans): each conversation rendered, in parts of about PART characters that follow on each other.

    turns: conv_id, turn, role, text; the template sees messages (turn, role, text). spans are the generated places of a
    part, in characters. Null roles and texts are empty, null turns come first, null conv_ids are one conversation; rows of
    one turn go by role, then text. An empty table gives no rows. Rows are dealt by conv_id and rendered as they stream in: a
    task holds a few rows and a part, however long a conversation is. Parts come in order, so that a reader that follows in
    the same stage needs no further shuffle.
    """
    compile_template(template)  # errors show here
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv_id, messages in _conversations(batches):
            part, texts, spans, size = 0, [], [], 0
            for text, generated in render({"messages": messages}):
                if generated and text:
                    if spans and spans[-1]["end"] == size:
                        spans[-1]["end"] = size + len(text)
                    else:
                        spans.append({"start": size, "end": size + len(text)})
                texts.append(text)
                size += len(text)
                if size >= PART:
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "part": part, "text": "".join(texts), "spans": spans}], schema=_PARTS)
                    part, texts, spans, size = part + 1, [], [], 0
            if texts or not part:
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "part": part, "text": "".join(texts), "spans": spans}], schema=_PARTS)
            for _ in messages:  # what the template left
                pass

    own = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return own.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(rendered, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """What format_conversations() made with the template TURNS, read again: digests of the turns and of the text under the loss.

    parts must come in order within partitions, as that function gives them. conv_id, n_turns, turns_sha256 (role, line feed,
    text, line feed of each turn), loss_chars and loss_sha256 (the unescaped text in spans), formatted_chars.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Reader:
            def __init__(self, conv_id):
                self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
                self.all, self.loss, self.rest, self.half, self.inside = hashlib.sha256(), hashlib.sha256(), "", "", False

            def add(self, text: str, spans: list[dict]) -> None:
                self.chars += len(text)
                for s in spans:
                    raw = self.half + text[s["start"] : s["end"]]
                    # an escape that the part's end cuts in two waits for the next part
                    tail = len(raw) - len(raw.rstrip("\\"))
                    self.half = "\\" if tail % 2 else ""
                    plain = unescape(raw[: len(raw) - len(self.half)])
                    self.loss_chars += len(plain)
                    self.loss.update(plain.encode("utf-8", "surrogatepass"))
                self.rest += text
                at = 0
                while at < len(self.rest):  # a turn's text is digested as it comes, each character once
                    if self.inside:
                        m = _INSIDE.match(self.rest, at)
                        self.all.update(unescape(m[0]).encode("utf-8", "surrogatepass"))
                        at = m.end()
                        if not self.rest.startswith(_CLOSE, at):
                            break
                        at, self.inside = at + len(_CLOSE), False
                        self.all.update(b"\n")
                    else:
                        m = _OPEN.match(self.rest, at)
                        if not m:
                            break
                        at, self.inside = m.end(), True
                        self.turns += 1
                        self.all.update(f"{unescape(m[1])}\n".encode("utf-8", "surrogatepass"))
                self.rest = self.rest[at:]

            def row(self) -> dict:
                if self.rest or self.inside:
                    raise ValueError(f"conversation {self.conv_id}: {self.rest[:80]!r} isn't a turn")
                return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}

        now: Reader | None = None
        done: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if r["part"] == 0:
                    if now:
                        done.append(now.row())
                    now = Reader(r["conv_id"])
                now.add(r["text"], r["spans"])
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema=_READ)
                    done = []
        if now:
            done.append(now.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_READ)

    return parts.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
