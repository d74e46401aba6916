"""Text of the query language to syntax trees, by recursive descent."""

from __future__ import annotations

import re
from typing import Any

from .syntax import Chain, Change, Clause, Command, Compose, EdgePattern, Ex, Explain, Match, Next, NodePattern, Project, Query

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|--[^\n]*|/\*.*?\*/)
    |(?P<bytes>[xX]'(?:[0-9a-fA-F]{2})*')
    |(?P<number>0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdDmM]?|\d[\d_]*(?:[eE][+-]?\d+[fFdDmM]?|[fFdDmM](?![\w])|\.(?![.\w]))?)
    |(?P<raw>@(?:'[^']*'|"[^"]*"|`[^`]*`))
    |(?P<string>'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*")
    |(?P<quoted>`(?:[^`]|``)*`)
    |(?P<param>\$[^\W\d]\w*)
    |(?P<word>[^\W\d]\w*)
    |(?P<sign><->|=>|<-\[|\]->|->|<-|<~\[|\]~>|~>|<~|\]-|\]~|-\[|~\[|::|<>|<=|>=|\|\||\.\.|[-+*/=<>(){}\[\],.:;|&!%~?])""",
    re.VERBOSE | re.DOTALL,
)

RESERVED = set("""MATCH OPTIONAL WHERE FILTER LET FOR IN WITH RETURN ORDER BY ASC DESC LIMIT OFFSET SKIP UNION INTERSECT EXCEPT OTHERWISE ALL DISTINCT GROUP HAVING AS AND OR XOR
NOT IS NULL TRUE FALSE UNKNOWN CASE WHEN THEN ELSE END CALL YIELD NEXT INSERT SET REMOVE DELETE DETACH NODETACH MERGE FINISH SELECT FROM EXISTS CAST STARTS ENDS CONTAINS""".split())

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "STDDEV_POP", "STDDEV_SAMP", "COLLECT_LIST", "PERCENTILE_CONT", "PERCENTILE_DISC"}
NOW = {"CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "LOCAL_TIMESTAMP"}
#: Words that make a literal of the string after them.
TEXTUAL = {"DATE", "TIME", "DATETIME", "TIMESTAMP", "DURATION", "ZONED", "LOCAL", "UUID"}
#: Types that are known and not supported.
NO_TYPES = {"INT256", "INTEGER256", "UINT256", "FLOAT16", "FLOAT128", "FLOAT256", "GRAPH", "TABLE"}


class GqlError(Exception):
    """A query that cannot be parsed, bound or run; ``code`` is its status."""

    def __init__(self, message: str, code: str = "42N01"):
        super().__init__(f"{code}: {message}")
        self.code = code


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i, self.hidden = text, [], 0, 0
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise GqlError(f"unexpected {text[at]!r} at {at}", "42001")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group(), at))
            at = m.end()
        self.tokens.append(("end", "", at))

    # tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        kind, value, _ = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return kind, value

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        kind, value = self.peek(ahead)
        return kind == "word" and value.upper() in words

    def word(self, *words: str) -> str | None:
        if self.is_word(*words):
            self.i += 1
            return self.tokens[self.i - 1][1].upper()
        return None

    def words(self, *sequence: str) -> bool:
        if all(self.is_word(w, ahead=k) for k, w in enumerate(sequence)):
            self.i += len(sequence)
            return True
        return False

    def need_word(self, *words: str) -> str:
        return self.word(*words) or self.fail(" or ".join(words))

    def is_sign(self, *signs: str, ahead: int = 0) -> bool:
        kind, value = self.peek(ahead)
        return kind == "sign" and value in signs

    def sign(self, *signs: str) -> str | None:
        if self.is_sign(*signs):
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, *signs: str) -> str:
        return self.sign(*signs) or self.fail(" or ".join(signs))

    def fail(self, wanted: str) -> Any:
        raise GqlError(f"expected {wanted}, found {self.peek()[1] or 'the end'!r} at {self.tokens[self.i][2]}", "42001")

    def name(self) -> str:
        kind, value = self.peek()
        if kind == "quoted":
            self.i += 1
            return value[1:-1].replace("``", "`")
        if kind == "string" and value[0] == '"':
            self.i += 1
            return unquote(value)
        if kind == "word" and value.upper() not in RESERVED:
            self.i += 1
            return value
        return self.fail("a name")

    def key(self) -> str:
        """A property name: any word will do."""
        if self.peek()[0] == "word":
            self.i += 1
            return self.tokens[self.i - 1][1]
        return self.name()

    def fresh(self) -> str:
        self.hidden += 1
        return f"·{self.hidden}"

    def listed(self, one):
        out = [one()]
        while self.sign(","):
            out.append(one())
        return out

    # statements

    def statement(self) -> Any:
        if self.word("EXPLAIN"):
            return Explain(self.statement())
        out = self.command() or self.composite()
        self.sign(";")
        if self.peek()[0] != "end":
            self.fail("the end")
        return out

    def composite(self) -> Any:
        left = self.linear()
        while True:
            op = self.word("UNION", "INTERSECT", "EXCEPT", "OTHERWISE")
            if op:
                every = bool(self.word("ALL")) if op != "OTHERWISE" else True
                if not every:
                    self.word("DISTINCT")
                left = Compose(op, every, left, self.linear())
            elif self.word("NEXT"):
                left = Next(left, self.composite())
            else:
                return left

    def linear(self) -> Any:
        if self.is_sign("{"):
            self.need("{")
            out = self.composite()
            self.need("}")
            return out
        if self.word("AT"):
            self.reference()  # one catalog: a schema changes nothing but must be well formed
            return self.linear()
        if self.word("USE"):
            return Query((Clause("use", self.reference().split("/")[-1]), *self.linear().clauses))
        clauses: list = []
        while (c := self.clause()) is not None:
            clauses.append(c)
        if not clauses:
            self.fail("a statement")
        return Query(tuple(clauses))

    def clause(self) -> Any:
        if self.is_word("MATCH") or self.is_word("OPTIONAL") and self.is_word("MATCH", ahead=1):
            optional = bool(self.word("OPTIONAL"))
            self.need_word("MATCH")
            return self.match(optional)
        if self.word("FILTER"):
            self.word("WHERE")
            return Clause("filter", self.expr())
        if self.word("LET"):
            return Clause("let", self.listed(self.let))
        if self.word("FOR"):
            var = self.name()
            self.need_word("IN")
            source, position = self.expr(), None
            if self.is_word("WITH") and self.is_word("ORDINALITY", "OFFSET", ahead=1):
                self.i += 1
                position = (self.need_word("ORDINALITY", "OFFSET"), self.name())
            return Clause("for", (var, source, position))
        if self.word("WITH"):
            return self.project(final=False)
        if self.word("RETURN"):
            if self.words("NO", "BINDINGS"):
                return Project((), nothing=True)
            return self.project(final=True)
        if self.word("SELECT"):
            return self.select()
        if self.words("ORDER", "BY"):
            return Clause("order", self.listed(self.order_term))
        if self.word("OFFSET", "SKIP"):
            return Clause("offset", self.count())
        if self.word("LIMIT"):
            return Clause("limit", self.count())
        if self.is_word("CALL") or self.is_word("OPTIONAL") and self.is_word("CALL", ahead=1):
            optional = bool(self.word("OPTIONAL"))
            self.need_word("CALL")
            return self.call(optional)
        return self.change()

    def select(self) -> Any:
        distinct, items = self.quantified_items()
        source: list = []
        if self.word("FROM"):
            self.need_word("MATCH")
            m = self.match(False)
            source.append(m)
        if self.word("WHERE"):
            source.append(Clause("filter", self.expr()))
        group, having = self.grouping()
        if items is None and (not source or group is not None):
            raise GqlError("SELECT * needs FROM and no GROUP BY")
        return Query((*source, Project(items, distinct, group, having)))

    def count(self) -> Ex:
        kind, value = self.peek()
        if kind == "number" or kind == "param":
            return self.primary()
        return self.fail("a count")

    def let(self) -> tuple:
        kind = None
        if self.is_word("VALUE") and not self.is_sign("=", ahead=1):
            self.i += 1
            var = self.name()
            if not self.is_sign("="):
                self.sign("::") or self.word("TYPED")
                kind = self.type_name()
        else:
            var = self.name()
        self.need("=")
        e = self.expr()
        return var, Ex("cast", (e,), kind) if kind else e

    def order_term(self) -> tuple:
        e = self.expr()
        way = self.word("ASC", "ASCENDING", "DESC", "DESCENDING") or "ASC"
        nulls = self.need_word("FIRST", "LAST") if self.word("NULLS") else None
        return e, way.startswith("DESC"), nulls

    def quantified_items(self) -> tuple:
        distinct = bool(self.word("DISTINCT"))
        if not distinct:
            self.word("ALL")
        if self.sign("*"):
            return distinct, None
        return distinct, tuple(self.listed(self.item))

    def item(self) -> tuple:
        start = self.tokens[self.i][2]
        e = self.expr()
        text = self.text[start : self.tokens[self.i][2]].strip()
        if self.word("AS"):
            return e, self.name()
        return e, e.data if e.op == "var" else text

    def grouping(self) -> tuple:
        group = having = None
        if self.words("GROUP", "BY"):
            if self.is_sign("(") and self.is_sign(")", ahead=1):
                self.i += 2
                group = ()
            else:
                group = tuple(self.listed(self.expr))
        if self.word("HAVING"):
            having = self.expr()
        return group, having

    def project(self, final: bool) -> Project:
        distinct, items = self.quantified_items()
        group, having = self.grouping()
        if items is None and group is not None:
            raise GqlError("* cannot be grouped")
        where = self.expr() if not final and self.word("WHERE") else None
        return Project(items, distinct, group, having, where, final)

    def call(self, optional: bool) -> Clause:
        if self.is_sign("{", "("):
            scope = None
            if self.sign("("):
                scope = [] if self.is_sign(")") else self.listed(self.name)
                self.need(")")
            self.need("{")
            q = self.composite()
            self.need("}")
            wanted = self.listed(self.yielded) if self.word("YIELD") else None
            if wanted and wanted[0][0] != "*":
                q = Next(q, Query((Project(tuple((Ex("var", data=n), a) for n, a in wanted)),)))
            return Clause("subcall", (scope, q), optional)
        path = [self.name()]
        while self.sign("."):
            path.append(self.key())
        self.need("(")
        args = [] if self.is_sign(")") else self.listed(self.expr)
        self.need(")")
        wanted = None
        if self.word("YIELD"):
            wanted = self.listed(self.yielded)
        return Clause("call", (".".join(path).lower(), args, wanted), optional)

    def yielded(self) -> tuple:
        if self.sign("*"):
            return "*", None
        n = self.key()
        return n, self.name() if self.word("AS") else n

    # changes

    def change(self) -> Any:
        if self.word("INSERT"):
            return Change("insert", self.listed(self.chain))
        if self.word("SET"):
            return Change("set", self.listed(self.set_item))
        if self.word("REMOVE"):
            return Change("remove", self.listed(self.remove_item))
        if self.is_word("DETACH", "NODETACH", "DELETE"):
            detach = self.word("DETACH", "NODETACH") == "DETACH"
            self.need_word("DELETE")
            return Change("delete", self.listed(self.name), detach)
        if self.word("MERGE"):
            raise GqlError("MERGE is not supported")
        if self.word("FINISH"):
            return Change("finish")
        return None

    def set_item(self) -> tuple:
        var = self.name()
        if self.sign("."):
            key = self.key()
            self.need("=")
            return "property", var, key, self.expr()
        if self.word("IS") or self.sign(":"):
            return "label", var, self.name(), None
        self.need("=")
        return "all", var, None, self.property_map()

    def remove_item(self) -> tuple:
        var = self.name()
        if self.sign("."):
            return "property", var, self.key()
        self.word("IS") or self.need(":")
        return "label", var, self.name()

    # patterns

    def match(self, optional: bool) -> Match:
        selector, mode, different = None, "WALK", False
        while True:
            if self.is_sign("(") or self.peek(1)[1] == "=":
                break
            if w := self.word("ANY", "ALL", "SHORTEST"):
                if selector is not None:
                    raise GqlError("a pattern has one selector", "42001")
                if w == "SHORTEST":
                    selector = ("shortest", self.integer() if self.peek()[0] == "number" else 1)
                elif self.word("SHORTEST"):
                    selector = ("shortest", 1) if w == "ANY" else ("shortest_groups", 1)
                elif w == "ANY":
                    selector = ("shortest", self.integer() if self.peek()[0] == "number" else 1)
                else:
                    selector = ("all", None)
            elif w := self.word("WALK", "TRAIL", "ACYCLIC", "SIMPLE"):
                mode = w
            elif self.word("PATHS", "PATH"):
                pass
            elif self.is_word("GROUPS", "GROUP") and selector and selector[0] == "shortest":
                self.i += 1
                selector = ("shortest_groups", selector[1])
            elif w := self.word("DIFFERENT", "REPEATABLE"):
                different = w == "DIFFERENT"
                if self.word("ELEMENT", "EDGE", "RELATIONSHIP"):
                    self.word("BINDINGS")
                else:
                    self.need_word("ELEMENTS", "EDGES", "RELATIONSHIPS")
            else:
                break
        chains = tuple(self.listed(self.chain))
        where = self.expr() if self.word("WHERE") else None
        return Match(chains, where, optional, selector, mode, different)

    def integer(self) -> int:
        kind, value = self.peek()
        if kind != "number" or not value.isdigit():
            self.fail("a whole number")
        self.i += 1
        return int(value)

    def chain(self) -> Chain:
        path = None
        if self.peek()[0] in ("word", "quoted") and self.is_sign("=", ahead=1):
            path = self.name()
            self.need("=")
        items: list = [self.node()]
        while self.is_sign("-[", "<-[", "~[", "<~[", "->", "<-", "<->", "~>", "<~", "~", "-"):
            items.append(self.edge())
            items.append(self.node())
        return Chain(tuple(items), path)

    def element(self, close: tuple[str, ...], edge: bool) -> tuple:
        var = self.name() if self.peek()[0] in ("word", "quoted") and not self.is_word("WHERE") else None
        label = None
        if self.sign(":") or self.word("IS"):
            label = self.label_or()
        quantifier = self.quantifier() if edge else None
        props = self.property_map() if self.is_sign("{") else ()
        where = self.expr() if self.word("WHERE") else None
        return var, label, props, where, quantifier

    def node(self) -> NodePattern:
        self.need("(")
        var, label, props, where, _ = self.element((")",), False)
        self.need(")")
        return NodePattern(var or self.fresh(), label, props, where, var is not None)

    #: Opening and closing signs of an edge, and the ways that it matches.
    FULL = {("-[", "]->"): "R", ("<-[", "]->"): "RL", ("<-[", "]-"): "L", ("~[", "]~>"): "UR", ("<~[", "]~"): "LU", ("~[", "]~"): "U", ("-[", "]-"): "RLU"}
    SHORT = {"->": "R", "<->": "RL", "<-": "L", "~>": "UR", "<~": "LU", "~": "U", "-": "RLU"}

    def edge(self) -> EdgePattern:
        s = self.need("-[", "<-[", "~[", "<~[", *self.SHORT)
        if s in self.SHORT:
            return EdgePattern(self.fresh(), frozenset(self.SHORT[s]), named=False)
        var, label, props, where, quantifier = self.element((), True)
        ways = self.FULL.get((s, self.need("]->", "]-", "]~>", "]~"))) or self.fail("a matching end of the edge")
        quantifier = quantifier or self.quantifier()
        return EdgePattern(var or self.fresh(), frozenset(ways), label, props, where, quantifier, var is not None)

    def quantifier(self) -> Any:
        if self.sign("+"):
            return 1, None
        if self.sign("?"):
            return "?"
        if self.sign("*"):
            if self.peek()[0] != "number":
                return 0, None
            low = self.integer()
            self.need("..")
            return low, self.integer() if self.peek()[0] == "number" else None
        if self.is_sign("{") and (self.is_sign(",", ahead=1) or self.peek(1)[0] == "number"):
            self.need("{")
            low = self.integer() if self.peek()[0] == "number" else 0
            high: int | None = low
            if self.sign(","):
                high = self.integer() if self.peek()[0] == "number" else None
            self.need("}")
            if high is not None and high < low:
                raise GqlError("a quantifier's upper bound lies below its lower one")
            return low, high
        return None

    def property_map(self) -> tuple:
        self.need("{")
        out = self.listed(lambda: (self.key(), self.need(":") and self.expr()))
        self.need("}")
        return tuple(out)

    def label_or(self) -> Any:
        out = self.label_and()
        while self.sign("|"):
            out = ("or", out, self.label_and())
        return out

    def label_and(self) -> Any:
        out = self.label_not()
        while self.sign("&", ":"):
            out = ("and", out, self.label_not())
        return out

    def label_not(self) -> Any:
        if self.sign("!"):
            return ("not", self.label_not())
        if self.sign("%"):
            return ("any",)
        if self.sign("("):
            out = self.label_or()
            self.need(")")
            return out
        return ("label", self.key())  # any word may be a label

    # expressions, from the weakest operator

    def expr(self) -> Ex:
        e = self.xor()
        while self.word("OR"):
            e = Ex("or", (e, self.xor()))
        return e

    def xor(self) -> Ex:
        e = self.conjunction()
        while self.word("XOR"):
            e = Ex("xor", (e, self.conjunction()))
        return e

    def conjunction(self) -> Ex:
        e = self.negation()
        while self.word("AND"):
            e = Ex("and", (e, self.negation()))
        return e

    def negation(self) -> Ex:
        if self.is_word("NOT"):
            self.i += 1
            return Ex("not", (self.negation(),))
        return self.predicate()

    def predicate(self) -> Ex:
        e = self.comparison()
        if self.word("IS"):
            no = bool(self.word("NOT"))
            if self.word("NULL"):
                out = Ex("is_null", (e,))
            elif w := self.word("TRUE", "FALSE", "UNKNOWN"):
                out = Ex("is_truth", (e,), w)
            elif self.word("LABELED"):
                self.need(":")
                out = Ex("is_labeled", (e,), self.label_or())
            elif self.words("SOURCE", "OF"):
                out = Ex("is_end", (e, self.comparison()), "src")
            elif self.words("DESTINATION", "OF"):
                out = Ex("is_end", (e, self.comparison()), "dst")
            elif self.word("DIRECTED"):
                out = Ex("is_directed", (e,))
            elif self.word("TYPED"):
                out = Ex("is_typed", (e,), self.type_name())
            else:
                form = self.word("NFC", "NFD", "NFKC", "NFKD") or "NFC"
                self.need_word("NORMALIZED")
                out = Ex("is_normalized", (e,), form)
            return Ex("not", (out,)) if no else out
        if self.is_word("IN") or self.is_word("NOT") and self.is_word("IN", ahead=1):
            no = bool(self.word("NOT"))
            self.need_word("IN")
            out = Ex("in", (e, self.comparison()))
            return Ex("not", (out,)) if no else out
        if self.words("STARTS", "WITH"):
            return Ex("startswith", (e, self.comparison()))
        if self.words("ENDS", "WITH"):
            return Ex("endswith", (e, self.comparison()))
        if self.word("CONTAINS"):
            return Ex("contains", (e, self.comparison()))
        return e

    def comparison(self) -> Ex:
        e = self.concat()
        if s := self.sign("<>", "<=", ">=", "<", ">", "="):
            e = Ex("compare", (e, self.concat()), s)
        return e

    def concat(self) -> Ex:
        e = self.addition()
        while self.sign("||"):
            e = Ex("concat", (e, self.addition()))
        return e

    def addition(self) -> Ex:
        e = self.product()
        while s := self.sign("+", "-"):
            e = Ex("arith", (e, self.product()), s)
        return e

    def product(self) -> Ex:
        e = self.unary()
        while s := self.sign("*", "/"):
            e = Ex("arith", (e, self.unary()), s)
        return e

    def unary(self) -> Ex:
        if self.sign("-"):
            return Ex("negative", (self.unary(),))
        if self.sign("+"):
            return self.unary()
        e = self.primary()
        while self.sign("."):
            e = Ex("prop", (e,), self.key())
        return e

    def arguments(self) -> list[Ex]:
        self.need("(")
        out = [] if self.is_sign(")") else self.listed(self.expr)
        self.need(")")
        return out

    def primary(self) -> Ex:
        kind, value = self.peek()
        if kind == "number":
            self.i += 1
            return number(value)
        if kind == "string" and value[0] == "'":
            self.i += 1
            return Ex("lit", data=unquote(value))
        if kind == "string":
            self.i += 1
            return Ex("lit", data=unquote(value))
        if kind == "raw":
            self.i += 1
            return Ex("lit", data=value[2:-1])
        if kind == "bytes":
            self.i += 1
            return Ex("lit", data=bytes.fromhex(value[2:-1]))
        if kind == "param":
            self.i += 1
            out = Ex("param", data=value[1:])
            return Ex("cast", (out,), self.type_name()) if self.sign("::") else out
        if kind == "quoted":
            return Ex("var", data=self.name())
        if self.sign("("):
            e = self.expr()
            self.need(")")
            return e
        if self.sign("["):
            items = [] if self.is_sign("]") else self.listed(self.expr)
            self.need("]")
            return Ex("list", tuple(items))
        if self.is_sign("{") or self.is_word("RECORD") and self.is_sign("{", ahead=1):
            self.word("RECORD")
            pairs = self.property_map()
            return Ex("record", tuple(v for _, v in pairs), tuple(k for k, _ in pairs))
        if kind != "word":
            return self.fail("an expression")
        return self.worded(value.upper())

    def worded(self, w: str) -> Ex:
        called = self.is_sign("(", ahead=1)
        if w in ("TRUE", "FALSE"):
            self.i += 1
            return Ex("lit", data=w == "TRUE")
        if w in ("NULL", "UNKNOWN", "NOTHING"):
            self.i += 1
            return Ex("null", data="boolean" if w == "UNKNOWN" else None)
        if w == "CASE":
            return self.case()
        if w == "CAST":
            self.i += 1
            self.need("(")
            e = self.expr()
            self.need_word("AS")
            kind = self.type_name()
            self.need(")")
            return Ex("cast", (e,), kind)
        if w == "EXISTS":
            self.i += 1
            close = "}" if self.need("{", "(") == "{" else ")"
            q = self.composite() if self.is_word("MATCH") else Query((Match(tuple(self.listed(self.chain)), self.expr() if self.word("WHERE") else None),))
            self.need(close)
            return Ex("exists", data=q)
        if w == "VALUE" and self.is_sign("{", ahead=1):
            self.i += 2
            q = self.composite()
            self.need("}")
            return Ex("value", data=q)
        if w == "PATH" and self.is_sign("[", ahead=1):
            self.i += 2
            items = self.listed(self.expr)
            self.need("]")
            return Ex("path", tuple(items))
        if w in NOW or w == "LOCAL_TIME" and not called or w == "LOCAL_TIME" and self.is_sign(")", ahead=2):
            self.i += 3 if called else 1
            return Ex("now", data=w)
        if w in TEXTUAL and (self.peek(1)[0] in ("string", "raw") or self.peek(2)[0] in ("string", "raw") and w in ("ZONED", "LOCAL")):
            kind = w
            self.i += 1
            if w in ("ZONED", "LOCAL"):
                kind += "_" + self.need_word("DATETIME", "TIME")
            sort, text = self.peek()
            text = text[2:-1] if sort == "raw" else unquote(text)
            self.i += 1
            return Ex("fn", (Ex("lit", data=text),), kind)
        if called and w in AGGREGATES:
            return self.aggregate(w)
        if called and w == "TRIM":
            return self.trim()
        if called and w == "NORMALIZE":
            self.i += 2
            e = self.expr()
            form = self.need_word("NFC", "NFD", "NFKC", "NFKD") if self.sign(",") else "NFC"
            self.need(")")
            return Ex("normalize", (e,), form)
        if called and w == "DURATION_BETWEEN":
            self.i += 1
            a, b = self.arguments()
            months = self.words("YEAR", "TO", "MONTH")
            self.words("DAY", "TO", "SECOND")
            return Ex("duration_between", (a, b), "months" if months else "seconds")
        if called:
            self.i += 1
            return Ex("fn", tuple(self.arguments()), w)
        return Ex("var", data=self.name())

    def aggregate(self, w: str) -> Ex:
        self.i += 2
        distinct = bool(self.word("DISTINCT"))
        self.word("ALL")
        if self.sign("*"):
            if distinct:
                raise GqlError("DISTINCT * cannot be counted")
            args: list = []
        else:
            args = self.listed(self.expr)
        self.need(")")
        return Ex("agg", tuple(args), (w, distinct))

    def trim(self) -> Ex:
        self.i += 2
        side = self.word("LEADING", "TRAILING", "BOTH")
        if side and self.word("FROM"):
            chars: Ex = Ex("lit", data=" ")
            e = self.expr()
        else:
            chars, e = Ex("lit", data=" "), self.expr()
            if self.word("FROM"):
                chars, e = e, self.expr()
            elif not side and self.sign(","):
                n = self.expr()
                self.need(")")
                return Ex("trim_list", (e, n))
        self.need(")")
        return Ex("trim", (e, chars), side or "BOTH")

    def case(self) -> Ex:
        self.need_word("CASE")
        subject = None if self.is_word("WHEN") else self.expr()
        parts: list[Ex] = []
        while self.word("WHEN"):
            tests = self.listed(self.expr) if subject is not None else [self.expr()]
            self.need_word("THEN")
            result = self.expr()
            if subject is not None:
                tests = [Ex("compare", (subject, t), "=") for t in tests]
            test = tests[0]
            for t in tests[1:]:
                test = Ex("or", (test, t))
            parts += [test, result]
        other = self.expr() if self.word("ELSE") else Ex("null")
        self.need_word("END")
        return Ex("case", (*parts, other))

    def type_name(self) -> tuple:
        """(NAME, arguments); a union is (UNION, types)."""
        out = [self.one_type()]
        while self.sign("|"):
            out.append(self.one_type())
        return out[0] if len(out) == 1 else ("UNION", tuple(out))

    def one_type(self) -> tuple:
        w = self.key().upper()
        unsigned = w == "UNSIGNED"
        if w in ("SIGNED", "UNSIGNED"):
            w = self.key().upper()
        if w in ("ZONED", "LOCAL"):
            w += "_" + self.need_word("DATETIME", "TIME")
        elif w == "PROPERTY":
            self.need_word("VALUE")
            w = "ANY"
        elif w == "DOUBLE":
            self.word("PRECISION")
        elif w in ("SMALL", "BIG"):
            w += self.need_word("INTEGER", "INT")
            w = {"S": "SMALLINT", "B": "BIGINT"}[w[0]]
        elif w == "ANY":
            self.words("PROPERTY", "VALUE") or self.word("VALUE")
        if unsigned:
            w = "U" + w.replace("INTEGER", "INT")
        if w in NO_TYPES:
            raise GqlError(f"the type {w} is not supported")
        args: list = []
        if w == "RECORD" and self.sign("{"):
            while not self.is_sign("}"):
                name = self.key()
                self.sign("::") or self.word("TYPED")
                args.append((name, self.type_name()))
                if not self.sign(","):
                    break
            self.need("}")
        if self.sign("<"):
            args.append(self.type_name())
            self.need(">")
        if w == "DURATION" and self.is_sign("("):
            self.need("(")
            if self.words("YEAR", "TO", "MONTH"):
                args.append("months")
            else:
                self.words("DAY", "TO", "SECOND") or self.fail("a duration's fields")
            self.need(")")
        for opening, closing in (("(", ")"), ("[", "]")):
            if self.sign(opening):
                args += self.listed(self.integer)
                self.need(closing)
        if self.words("NOT", "NULL"):
            args.append("NOT NULL")
        out = (w, tuple(args))
        while self.word("LIST", "ARRAY"):
            bound = []
            if self.sign("["):
                bound = self.listed(self.integer)
                self.need("]")
            out = ("LIST", (out, *bound))
        return out

    # catalog, session, transaction

    def command(self) -> Command | None:
        if self.words("START", "TRANSACTION"):
            read = bool(self.words("READ", "ONLY"))
            self.words("READ", "WRITE")
            return Command("start", {"read_only": read})
        if w := self.word("COMMIT", "ROLLBACK"):
            return Command(w.lower())
        if self.word("SESSION"):
            return self.session()
        if self.is_word("SHOW"):
            self.i += 1
            if self.words("NODE", "TYPES"):
                return Command("show", {"what": "node types"})
            if self.words("EDGE", "TYPES"):
                return Command("show", {"what": "edge types"})
            return Command("show", {"what": self.need_word("INDEXES", "PROCEDURES").lower()})
        if self.is_word("CREATE", "DROP", "ALTER", "TRUNCATE"):
            return self.definition()
        return None

    def session(self) -> Command:
        if self.word("CLOSE"):
            return Command("session_close")
        if self.word("RESET"):
            self.word("PROPERTY")
            if self.word("ALL", "PARAMETERS", "CHARACTERISTICS"):
                self.word("PARAMETERS", "CHARACTERISTICS")
            elif self.words("TIME", "ZONE"):
                return Command("session_reset", {"what": "zone"})
            elif self.word("PARAMETER"):
                return Command("session_reset", {"what": "parameter", "name": self.peek()[1][1:], "_": self.skip()})
            elif w := self.word("SCHEMA", "GRAPH"):
                return Command("session_reset", {"what": w.lower()})
            return Command("session_reset", {"what": "all"})
        self.need_word("SET")
        if self.words("TIME", "ZONE"):
            return Command("session_set", {"what": "zone", "value": self.primary().data})
        if w := self.word("SCHEMA", "GRAPH"):
            return Command("session_set", {"what": w.lower(), "value": self.reference()})
        self.need_word("VALUE")
        name = self.peek()[1]
        self.skip()
        self.need("=")
        return Command("session_set", {"what": "value", "name": name.lstrip("$"), "value": self.expr()})

    def skip(self) -> None:
        self.i += 1

    def reference(self) -> str:
        self.sign("/")
        parts = [self.name()]
        while self.sign("/", "."):
            parts.append(self.name())
        return "/".join(parts)

    def definition(self) -> Command:
        verb = self.need_word("CREATE", "DROP", "ALTER", "TRUNCATE").lower()
        replace = self.words("OR", "REPLACE")
        self.word("PROPERTY")
        if self.words("GRAPH", "TYPE"):
            kind = "graph type"
        elif w := self.word("SCHEMA", "GRAPH", "INDEX"):
            kind = w.lower()
        else:
            kind = f"{self.need_word('NODE', 'EDGE').lower()} type"
            self.need_word("TYPE")
        missing = self.words("IF", "NOT", "EXISTS")
        exists = not missing and self.words("IF", "EXISTS")
        self.sign(":")
        if kind == "schema" and not self.is_sign("/"):
            raise GqlError("a schema's name is an absolute path", "42001")
        data: dict = {"kind": kind, "replace": replace, "if_not_exists": missing, "if_exists": exists, "name": self.reference()}
        if kind == "index" and verb == "create":
            self.word("FOR", "ON")
            self.sign("(")
            self.sign(":")
            data["label"] = self.name()
            self.sign(")")
            self.need("(")
            data["properties"] = self.listed(self.key)
            self.need(")")
        elif kind == "graph" and verb == "create":
            if self.word("TYPED") or self.sign("::"):
                data["type"] = None if self.is_word("ANY") else self.reference()
            if self.word("ANY"):
                self.word("PROPERTY")
                self.word("GRAPH")
        elif kind.endswith("type"):
            if self.word("EXTENDS"):
                self.sign(":")
                data["extends"] = self.name()
            self.sign("=>")
            if kind == "graph type":
                self.word("AS")
                if self.sign("{"):
                    data["elements"] = [] if self.is_sign("}") else self.listed(self.element_type)
                    self.need("}")
                return Command(verb, data)
            if kind == "edge type" and (self.word("FROM") or self.is_sign("(") and self.is_sign(":", ahead=1)):
                self.sign("(")
                self.sign(":")
                data["source"] = self.name()
                self.sign(")")
                self.word("TO") or self.sign("->")
                self.sign("(")
                self.sign(":")
                data["target"] = self.name()
                self.sign(")")
            self.word("ADD")
            if opened := self.sign("(", "{"):
                if self.word("FROM"):
                    data["sources"] = self.end_labels("TO")
                    self.need_word("TO")
                    data["targets"] = self.end_labels(None)
                    self.sign(",")
                data["properties"] = [] if self.is_sign(")", "}") else self.listed(self.column)
                self.need(")" if opened == "(" else "}")
        if verb == "drop":
            data["cascade"] = self.word("CASCADE", "RESTRICT") == "CASCADE"
        return Command(verb, data)

    def end_labels(self, until: str | None) -> list[str]:
        out = []
        while self.sign(":"):
            out.append(self.key())
            if not (self.is_sign(",") and self.is_sign(":", ahead=1)):
                break
            self.i += 1
        return out

    def element_type(self) -> dict:
        """A node or edge type inside a graph type's body."""
        kind = f"{self.need_word('NODE', 'EDGE').lower()} type"
        self.word("TYPE")
        self.sign(":")
        out: dict = {"kind": kind, "name": self.name(), "properties": []}
        self.sign("=>")
        if opened := self.sign("(", "{"):
            out["properties"] = [] if self.is_sign(")", "}") else self.listed(self.column)
            self.need(")" if opened == "(" else "}")
        return out

    def column(self) -> dict:
        if opened := self.sign("("):
            self.sign(":")
        name = self.key()
        if opened:
            self.sign(")")
            return {"name": name, "type": ("NODE", ()), "constraints": set(), "default": None}
        self.sign("::") or self.word("TYPED")
        kind = self.type_name()
        out = {"name": name, "type": (kind[0], tuple(a for a in kind[1] if a != "NOT NULL")), "constraints": {"required"} if "NOT NULL" in kind[1] else set(), "default": None}
        while True:
            if self.words("NOT", "NULL"):
                out["constraints"].add("required")
            elif w := self.word("IMMUTABLE", "UNIQUE", "INDEXED"):
                out["constraints"].add(w.lower())
            elif self.word("DEFAULT"):
                out["default"] = self.unary()
            else:
                return out


def unquote(text: str) -> str:
    q = text[0]
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def one(m: re.Match) -> str:
        x = m.group()
        if x == q + q:
            return q
        if x[1] in "uU":
            return chr(int(x[2:], 16))
        return plain.get(x[1], x[1])

    return re.sub(rf"{q}{q}|\\u[0-9a-fA-F]{{4}}|\\U[0-9a-fA-F]{{6}}|\\.", one, text[1:-1], flags=re.DOTALL)


def number(text: str) -> Ex:
    from decimal import Decimal

    t = text.replace("_", "")
    if t[:2].lower() in ("0x", "0o", "0b"):
        return Ex("lit", data=int(t, 0))
    if t[-1] in "mM":
        return Ex("lit", data=Decimal(t[:-1]))
    if t[-1] in "fFdD":
        return Ex("lit", data=float(t[:-1]))
    if re.search(r"[eE]", t):
        return Ex("lit", data=float(t))
    return Ex("lit", data=float(t) if "." in t else int(t))


def parse(text: str) -> Any:
    return Parser(text).statement()
