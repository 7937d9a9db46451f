"""A recursive-descent parser for the PHP that applications are written in.

Nodes are small objects with a kind, a line and named fields. Names of classes
are resolved against the namespace and its imports while parsing.
"""

from __future__ import annotations

import re

from codequarry.php.lexer import PhpError, Token, tokenize

LIST_KINDS = (list, tuple)


class Node:
    __slots__ = ("kind", "line", "end", "f")

    def __init__(self, kind, line, **fields):
        self.kind, self.line, self.end, self.f = kind, line, line, fields

    def __getattr__(self, name):
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name, default=None):
        return self.f.get(name, default)

    def children(self):
        for v in self.f.values():
            if isinstance(v, Node):
                yield v
            elif isinstance(v, LIST_KINDS):
                for x in v:
                    if isinstance(x, Node):
                        yield x

    def walk(self, into=lambda n: True):
        """This node and all below, in source order; not into nodes that into() refuses."""
        yield self
        for c in self.children():
            if into(c):
                yield from c.walk(into)

    def __repr__(self):
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.f.items())})"


RESERVED = {"self", "static", "parent", "true", "false", "null", "int", "string", "bool", "float", "array", "mixed", "void", "never", "object", "callable", "iterable", "resource"}
BINARY = {
    "or": 1, "xor": 2, "and": 3, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12, "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13, "<": 14, "<=": 14, ">": 14, ">=": 14,
    ".": 15, "<<": 16, ">>": 16, "+": 17, "-": 17, "*": 18, "/": 18, "%": 18, "instanceof": 20, "**": 21,
}
ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "**=", "??=", "&=", "|=", "^=", "<<=", ">>="}
CASTS = {"int", "integer", "float", "double", "real", "string", "bool", "boolean", "array", "object", "unset", "binary"}
MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "readonly", "var"}


class Parser:
    def __init__(self, tokens: list[Token]):
        self.ts, self.at = tokens, 0
        self.namespace, self.uses = "", {}

    # --- tokens

    def peek(self, n=0) -> Token | None:
        return self.ts[self.at + n] if self.at + n < len(self.ts) else None

    def line(self) -> int:
        t = self.peek() or (self.ts[-1] if self.ts else None)
        return t.line if t else 1

    def is_(self, *texts, n=0) -> bool:
        t = self.peek(n)
        return t is not None and t.kind in ("op", "name") and t.text.lower() in texts

    def take(self, *texts) -> Token | None:
        if self.is_(*texts):
            self.at += 1
            return self.ts[self.at - 1]
        return None

    def need(self, *texts) -> Token:
        t = self.take(*texts)
        if t is None:
            got = self.peek()
            raise PhpError(f"line {self.line()}: expected {' or '.join(texts)}, found {got.text[:20] if got else 'the end'!r}")
        return t

    def kind(self, *kinds) -> Token | None:
        t = self.peek()
        if t is not None and t.kind in kinds:
            self.at += 1
            return t
        return None

    def name(self) -> str:
        t = self.kind("name")
        if t is None:
            raise PhpError(f"line {self.line()}: expected a name")
        return t.text

    def resolve(self, name: str) -> str:
        if name.startswith("\\"):
            return name[1:]
        if name.lower() in RESERVED:
            return name
        head, _, rest = name.partition("\\")
        if head.lower() in self.uses:
            return self.uses[head.lower()] + ("\\" + rest if rest else "")
        return f"{self.namespace}\\{name}".lstrip("\\")

    # --- statements

    def file(self) -> list[Node]:
        out = []
        while self.peek() is not None:
            s = self.statement()
            if s is not None:
                out.append(s)
        return out

    def block(self) -> list[Node]:
        if self.take("{"):
            out = []
            while not self.take("}"):
                if self.peek() is None:
                    raise PhpError(f"line {self.line()}: block without end")
                s = self.statement()
                if s is not None:
                    out.append(s)
            return out
        if self.take(":"):
            out = []
            while not self.is_("endif", "endforeach", "endfor", "endwhile", "endswitch", "else", "elseif", "case", "default"):
                if self.peek() is None:
                    raise PhpError(f"line {self.line()}: block without end")
                s = self.statement()
                if s is not None:
                    out.append(s)
            return out
        s = self.statement()
        return [s] if s is not None else []

    def statement(self) -> Node | None:
        t = self.peek()
        line = t.line
        if t.kind == "inline" or self.is_(";"):
            self.at += 1
            return None
        while self.is_("#["):
            self.attribute()
        if self.is_("{"):
            return Node("block", line, body=self.block())
        word = self.peek().text.lower() if self.peek() and self.peek().kind == "name" else ""
        nxt = self.peek(1)
        if word == "namespace" and nxt and (nxt.kind == "name" or nxt.text == "{"):
            self.at += 1
            self.namespace = self.name() if self.peek().kind == "name" else ""
            self.uses = {}
            if self.is_("{"):
                return Node("block", line, body=self.block())
            self.need(";")
            return None
        if word == "use":
            return self.use()
        if word in ("abstract", "final", "readonly") or word in ("class", "interface", "trait") or (word == "enum" and nxt and nxt.kind == "name"):
            return self.class_()
        if word == "function" and nxt and (nxt.kind == "name" or (nxt.text == "&" and self.peek(2).kind == "name")):
            self.at += 1
            self.take("&")
            return self.function("function", self.name(), line)
        method = getattr(self, f"st_{word}", None)
        if method and not (nxt and nxt.text in ("::", "(") and word in ("static", "match")):
            self.at += 1
            return method(line)
        e = self.expr()
        self.end_statement()
        return Node("expr", line, e=e)

    def end_statement(self):
        t = self.peek()
        if t is None or t.kind == "inline":
            return
        self.need(";")

    def use(self):
        self.at += 1
        kind = self.take("function", "const")
        while True:
            base = self.name()
            if self.take("{"):
                while not self.take("}"):
                    self.take("function", "const")
                    n = self.name()
                    alias = self.name() if self.take("as") else n.split("\\")[-1]
                    self.uses[alias.lower()] = f"{base.rstrip(chr(92))}\\{n}".lstrip("\\")
                    self.take(",")
            elif self.take("\\"):
                pass
            else:
                alias = self.name() if self.take("as") else base.split("\\")[-1]
                if not kind:
                    self.uses[alias.lower()] = base.lstrip("\\")
            if not self.take(","):
                break
        self.take(";")
        return None

    def attribute(self):
        self.need("#[")
        depth = 1
        while depth:
            t = self.peek()
            if t is None:
                raise PhpError("attribute without end")
            depth += (t.text in ("[", "#[")) - (t.text == "]") if t.kind == "op" else 0
            self.at += 1

    def st_if(self, line):
        self.need("(")
        cond = self.expr()
        self.need(")")
        alt = self.is_(":")
        then, other = self.block(), []
        if self.is_("elseif") or (self.is_("else") and self.is_("if", n=1)):
            l2 = self.line()
            if not self.take("elseif"):
                self.at += 2
            return Node("if", line, cond=cond, then=then, other=[self.st_if(l2)])
        if self.take("else"):
            other = self.block()
        if alt:
            self.take("endif")
            self.take(";")
        return Node("if", line, cond=cond, then=then, other=other)

    def st_while(self, line):
        self.need("(")
        cond = self.expr()
        self.need(")")
        body = self.block()
        if self.take("endwhile"):
            self.take(";")
        return Node("loop", line, head=[cond], body=body)

    def st_do(self, line):
        body = self.block()
        self.need("while")
        self.need("(")
        cond = self.expr()
        self.need(")")
        self.end_statement()
        return Node("loop", line, head=[cond], body=body)

    def st_for(self, line):
        self.need("(")
        head = []
        for end in (";", ";", ")"):
            while not self.take(end):
                head.append(self.expr())
                self.take(",")
        body = self.block()
        if self.take("endfor"):
            self.take(";")
        return Node("loop", line, head=head, body=body)

    def st_foreach(self, line):
        self.need("(")
        over = self.expr()
        self.need("as")
        self.take("&")
        value, key = self.expr(), None
        if self.take("=>"):
            self.take("&")
            key, value = value, self.expr()
        self.need(")")
        body = self.block()
        if self.take("endforeach"):
            self.take(";")
        return Node("foreach", line, over=over, key=key, value=value, body=body)

    def st_switch(self, line):
        self.need("(")
        cond = self.expr()
        self.need(")")
        close = "}" if self.take("{") else (self.need(":") and "endswitch")
        cases = []
        while not self.take(close):
            l2 = self.line()
            test = None
            if self.take("case"):
                test = self.expr()
            else:
                self.need("default")
            if not self.take(":"):
                self.need(";")
            body = []
            while not self.is_("case", "default", close):
                s = self.statement()
                if s is not None:
                    body.append(s)
            cases.append(Node("case", l2, test=test, body=body))
        return Node("switch", line, cond=cond, cases=cases)

    def st_return(self, line):
        e = None if self.is_(";") or self.peek() is None else self.expr()
        self.end_statement()
        return Node("return", line, e=e)

    def st_throw(self, line):
        e = self.expr()
        self.end_statement()
        return Node("throw", line, e=e)

    def st_echo(self, line):
        args = [self.expr()]
        while self.take(","):
            args.append(self.expr())
        self.end_statement()
        return Node("echo", line, args=args)

    def _skip(self, line):
        args = []
        while not self.is_(";") and self.peek() is not None and self.peek().kind != "inline":
            args.append(self.expr())
            self.take(",")
        self.end_statement()
        return Node("other", line, args=args)

    st_break = st_continue = st_global = st_goto = _skip

    def st_unset(self, line):
        args = self.arguments()
        self.end_statement()
        return Node("other", line, args=args)

    def st_static(self, line):
        return self._skip(line)

    def st_const(self, line):
        return self._skip(line)

    def st_declare(self, line):
        self.need("(")
        while not self.take(")"):
            self.at += 1
        if not self.take(";"):
            self.block()
        return None

    def st_try(self, line):
        body, catches, last = self.block(), [], []
        while self.take("catch"):
            l2 = self.line()
            self.need("(")
            types = [self.resolve(self.name())]
            while self.take("|"):
                types.append(self.resolve(self.name()))
            var = self.kind("var")
            self.need(")")
            catches.append(Node("catch", l2, types=types, var=var.text[1:] if var else None, body=self.block()))
        if self.take("finally"):
            last = self.block()
        return Node("try", line, body=body, catches=catches, last=last)

    # --- declarations

    def class_(self, anonymous=False) -> Node:
        line, flags = self.line(), set()
        while self.is_("abstract", "final", "readonly"):
            flags.add(self.take("abstract", "final", "readonly").text.lower())
        kind = self.need("class", "interface", "trait", "enum").text.lower()
        name = None if anonymous else self.name()
        if anonymous and self.is_("("):
            self.arguments()
        if kind == "enum" and self.take(":"):
            self.type_()
        parents, interfaces = [], []
        if self.take("extends"):
            parents.append(self.resolve(self.name()))
            while self.take(","):
                parents.append(self.resolve(self.name()))
        if self.take("implements"):
            interfaces.append(self.resolve(self.name()))
            while self.take(","):
                interfaces.append(self.resolve(self.name()))
        node = Node("class", line, type=kind, name=name, fqcn=f"{self.namespace}\\{name}".lstrip("\\") if name else None, parent=parents[0] if parents and kind == "class" else None, interfaces=interfaces + (parents if kind == "interface" else []), abstract="abstract" in flags, traits=[], methods=[], props=[], consts=[])
        self.need("{")
        while not self.take("}"):
            if self.peek() is None:
                raise PhpError(f"line {line}: class without end")
            self.member(node)
        node.end = self.ts[self.at - 1].line
        return node

    def member(self, node):
        while self.is_("#["):
            self.attribute()
        line = self.line()
        if self.take("use"):
            node.traits.append(self.resolve(self.name()))
            while self.take(","):
                node.traits.append(self.resolve(self.name()))
            if self.take("{"):
                while not self.take("}"):
                    self.at += 1
            else:
                self.need(";")
            return
        if self.is_("case") and node.f["type"] == "enum":
            self.at += 1
            self.name()
            if self.take("="):
                self.expr()
            self.need(";")
            return
        flags = set()
        while self.peek() and self.peek().kind == "name" and self.peek().text.lower() in MODIFIERS:
            flags.add(self.take(*MODIFIERS).text.lower())
        if self.take("const"):
            if self.peek(1) and self.peek(1).kind == "name":
                self.type_()
            while True:
                n = self.name()
                self.need("=")
                node.consts.append(Node("const", line, name=n, value=self.expr()))
                if not self.take(","):
                    break
            self.need(";")
            return
        if self.take("function"):
            self.take("&")
            node.methods.append(self.function("method", self.name(), line, flags))
            return
        type_ = None if self.peek() and self.peek().kind == "var" else self.type_()
        while True:
            v = self.kind("var")
            if v is None:
                raise PhpError(f"line {self.line()}: expected a property")
            value = self.expr() if self.take("=") else None
            node.props.append(Node("prop", line, name=v.text[1:], type=type_, value=value, static="static" in flags, visibility=next((x for x in ("private", "protected") if x in flags), "public")))
            if not self.take(","):
                break
        if self.take("{"):
            depth = 1
            while depth:
                t = self.peek()
                if t is None:
                    raise PhpError("hooks without end")
                depth += (t.text == "{") - (t.text == "}") if t.kind == "op" else 0
                self.at += 1
        else:
            self.need(";")

    def type_(self) -> str:
        out = ""
        self.take("?")
        while True:
            if self.take("("):
                out += self.type_()
                self.need(")")
            else:
                out += self.resolve(self.name())
            if self.is_("|") or (self.is_("&") and self.peek(1) and self.peek(1).kind == "name" or self.is_("&") and self.is_("(", n=1)):
                out += self.take("|", "&").text
                continue
            return out

    def parameters(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            while self.is_("#["):
                self.attribute()
            line, promoted = self.line(), None
            while self.is_("public", "protected", "private", "readonly"):
                promoted = self.take("public", "protected", "private", "readonly").text.lower()
            nullable = self.is_("?")
            type_ = None if self.peek().kind == "var" or self.is_("&", "...") else self.type_()
            self.take("&")
            variadic = bool(self.take("..."))
            v = self.kind("var")
            if v is None:
                raise PhpError(f"line {line}: expected a parameter")
            default = self.expr() if self.take("=") else None
            out.append(Node("param", line, name=v.text[1:], type=type_, nullable=nullable, default=default, promoted=promoted, variadic=variadic))
            self.take(",")
        return out

    def function(self, kind, name, line, flags=()) -> Node:
        params = self.parameters()
        uses = []
        if kind == "closure" and self.take("use"):
            uses = self.parameters()
        returns = self.type_() if self.take(":") else None
        body = None
        if not self.take(";"):
            body = self.block()
        node = Node(kind, line, name=name, params=params, uses=uses, returns=returns, body=body, static="static" in flags, abstract="abstract" in flags, visibility=next((x for x in ("private", "protected") if x in flags), "public"))
        node.end = self.ts[self.at - 1].line
        return node

    # --- expressions

    def expr(self, least=0) -> Node:
        left = self.unary()
        while True:
            t = self.peek()
            if t is None or t.kind not in ("op", "name"):
                return left
            op = t.text.lower()
            if op in ASSIGN and left.kind in ("var", "prop_fetch", "index", "static_prop", "array", "varvar"):
                self.at += 1
                self.take("&")
                left = Node("assign", t.line, op=op, to=left, value=self.expr(4))
                continue
            if op == "?" and least <= 5:
                self.at += 1
                if self.take(":"):
                    left = Node("ternary", t.line, cond=left, then=None, other=self.expr(6))
                else:
                    then = self.expr()
                    self.need(":")
                    left = Node("ternary", t.line, cond=left, then=then, other=self.expr(6))
                continue
            power = BINARY.get(op)
            if power is None or power < least:
                return left
            self.at += 1
            if op == "instanceof":
                right = Node("class_name", t.line, name=self.resolve(self.name())) if self.peek() and self.peek().kind == "name" else self.unary()
            else:
                right = self.expr(power if op in ("??", "**") else power + 1)
            left = Node("binary", t.line, op=op, left=left, right=right)

    def unary(self) -> Node:
        t = self.peek()
        if t is None:
            raise PhpError(f"line {self.line()}: expression expected")
        if t.kind == "op":
            if t.text in ("!", "-", "+", "~", "@", "&", "..."):
                self.at += 1
                return Node("unary", t.line, op=t.text, e=self.expr(19 if t.text != "!" else 19))
            if t.text in ("++", "--"):
                self.at += 1
                return Node("unary", t.line, op=t.text, e=self.unary())
            if t.text == "(" and self.peek(1) and self.peek(1).kind == "name" and self.peek(1).text.lower() in CASTS and self.is_(")", n=2):
                cast = self.peek(1).text.lower()
                self.at += 3
                return Node("cast", t.line, to=cast, e=self.unary())
        if t.kind == "name":
            w = t.text.lower()
            if w == "new":
                return self.postfix(self.new())
            if w in ("clone", "print", "throw", "yield", "include", "include_once", "require", "require_once", "exit", "die"):
                self.at += 1
                if w == "yield" and self.take("from"):
                    pass
                if w in ("exit", "die"):
                    return Node("call", t.line, name="exit", args=self.arguments() if self.is_("(") else [])
                if self.is_(";", ")", ",", "]"):
                    return Node("word", t.line, word=w, e=None)
                e = self.expr(4 if w in ("yield", "throw", "print") else 19 if w == "clone" else 4)
                if w == "yield" and self.take("=>"):
                    e = self.expr(4)
                return Node("word", t.line, word=w, e=e)
        return self.postfix(self.primary())

    def new(self) -> Node:
        line = self.line()
        self.at += 1
        while self.is_("#["):
            self.attribute()
        if self.is_("class", "readonly"):
            return Node("new", line, cls=None, args=[], body=self.class_(anonymous=True))
        t = self.peek()
        if t.kind == "name":
            cls = Node("class_name", line, name=self.resolve(self.name()))
        elif self.take("("):
            cls = self.expr()
            self.need(")")
        else:
            cls = self.primary()
            while self.is_("->", "::"):
                self.at += 1
                self.at += 1
        return Node("new", line, cls=cls, args=self.arguments() if self.is_("(") else [])

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            line, label = self.line(), None
            if self.is_("...") and self.is_(")", n=1):
                self.at += 1
                continue
            if self.peek() and self.peek().kind == "name" and self.is_(":", n=1) and not self.is_("::", n=1):
                label = self.name()
                self.need(":")
            out.append(Node("arg", line, e=self.expr(), label=label))
            self.take(",")
        return out

    def postfix(self, e: Node) -> Node:
        while True:
            t = self.peek()
            if t is None or t.kind != "op":
                return e
            line = t.line
            if t.text in ("->", "?->"):
                self.at += 1
                n = self.peek()
                if n.kind == "name":
                    name = self.name()
                elif n.kind == "var":
                    self.at += 1
                    name = None
                else:
                    self.need("{")
                    self.expr()
                    self.need("}")
                    name = None
                e = Node("method_call", n.line, on=e, name=name, args=self.arguments()) if self.is_("(") else Node("prop_fetch", n.line, on=e, name=name)
            elif t.text == "::":
                self.at += 1
                n = self.peek()
                if n.kind == "var":
                    self.at += 1
                    e = Node("static_call", line, cls=e, name=None, args=self.arguments()) if self.is_("(") else Node("static_prop", line, cls=e, name=n.text[1:])
                elif n.kind == "name":
                    name = self.name()
                    e = Node("static_call", line, cls=e, name=name, args=self.arguments()) if self.is_("(") else Node("class_const", line, cls=e, name=name)
                else:
                    self.need("{")
                    self.expr()
                    self.need("}")
                    e = Node("class_const", line, cls=e, name=None)
            elif t.text == "[":
                self.at += 1
                key = None if self.is_("]") else self.expr()
                self.need("]")
                e = Node("index", line, on=e, key=key)
            elif t.text == "(":
                args = self.arguments()
                e = Node("call", line, name=e.name, args=args) if e.kind == "constant" else Node("dyn_call", line, on=e, args=args)
            elif t.text in ("++", "--"):
                self.at += 1
                e = Node("unary", line, op=t.text, e=e)
            else:
                return e

    def primary(self) -> Node:
        t = self.peek()
        line = t.line
        if t.kind == "var":
            self.at += 1
            return Node("var", line, name=t.text[1:])
        if t.kind in ("int", "float"):
            self.at += 1
            return Node("number", line, value=t.text)
        if t.kind == "string":
            self.at += 1
            return Node("string", line, value=t.text)
        if t.kind == "template":
            self.at += 1
            return template(t.text, line, self)
        if t.kind == "op":
            if t.text == "(":
                self.at += 1
                e = self.expr()
                self.need(")")
                return e
            if t.text == "[":
                self.at += 1
                return self.array("]", line)
            if t.text == "$":
                self.at += 1
                if self.take("{"):
                    e = self.expr()
                    self.need("}")
                else:
                    e = self.primary()
                return Node("varvar", line, e=e)
            if t.text == "#[":
                self.attribute()
                return self.primary()
        if t.kind == "name":
            w = t.text.lower()
            if w == "static" and self.is_("function", "fn", n=1):
                self.at += 1
                w = self.peek().text.lower()
            if w == "function":
                self.at += 1
                self.take("&")
                return self.function("closure", None, line)
            if w == "fn":
                self.at += 1
                self.take("&")
                params = self.parameters()
                if self.take(":"):
                    self.type_()
                self.need("=>")
                return Node("arrow", line, params=params, e=self.expr(4))
            if w in ("array", "list") and self.is_("(", n=1):
                self.at += 2
                return self.array(")", line)
            if w in ("isset", "empty", "unset") and self.is_("(", n=1):
                self.at += 1
                return Node("call", line, name=w, args=self.arguments())
            if w == "match" and self.is_("(", n=1):
                return self.match(line)
            self.at += 1
            if self.is_("::"):
                return Node("class_name", line, name=self.resolve(t.text))
            return Node("constant", line, name=t.text.lstrip("\\"))
        raise PhpError(f"line {line}: unexpected {t.text[:20]!r}")

    def match(self, line):
        self.at += 1
        self.need("(")
        cond = self.expr()
        self.need(")")
        self.need("{")
        arms = []
        while not self.take("}"):
            l2, tests = self.line(), []
            if self.is_("default") and self.is_("=>", ",", n=1):
                self.at += 1
                self.take(",")
            else:
                while not self.is_("=>"):
                    tests.append(self.expr())
                    self.take(",")
            self.need("=>")
            arms.append(Node("arm", l2, tests=tests, e=self.expr()))
            self.take(",")
        return Node("match", line, cond=cond, arms=arms)

    def array(self, close, line) -> Node:
        items = []
        while not self.take(close):
            if self.take(","):
                continue
            l2 = self.line()
            self.take("&")
            value, key = self.expr(), None
            if self.take("=>"):
                self.take("&")
                key, value = value, self.expr()
            items.append(Node("item", l2, key=key, value=value))
            if not self.is_(close):
                self.need(",")
        return Node("array", line, items=items)


_PART = re.compile(r"\{(\$[^{}]*(?:\{[^{}]*\}[^{}]*)*)\}|\$([A-Za-z_]\w*)(\[[^\]]*\]|\??->[A-Za-z_]\w*)?|\$\{([A-Za-z_]\w*)\}")


def template(text: str, line: int, parser: Parser) -> Node:
    """A string with variables in it: parts are strings and expressions."""
    parts, at = [], 0
    for m in _PART.finditer(text):
        if m.start() and text[m.start() - 1] == "\\":
            continue
        if m.start() > at:
            parts.append(Node("string", line, value=text[at : m.start()]))
        source = m[1] or "$" + (m[2] or m[4]) + (m[3] or "")
        if m[3] and m[3].startswith("[") and not m[3][1:2].isdigit() and m[3][1:2] not in "$'\"":
            source = f"${m[2]}['{m[3][1:-1]}']"
        inner = Parser([Token(t.kind, t.text, line, 0) for t in tokenize("<?php " + source)])
        inner.namespace, inner.uses = parser.namespace, parser.uses
        try:
            parts.append(inner.expr())
        except PhpError:
            parts.append(Node("unknown", line))
        at = m.end()
    if at < len(text):
        parts.append(Node("string", line, value=text[at:]))
    return Node("template", line, parts=parts)


def parse(code: str) -> list[Node]:
    """Statements of a file; PhpError when it cannot be read."""
    try:
        return Parser(tokenize(code)).file()
    except (RecursionError, IndexError, AttributeError) as e:
        raise PhpError(f"not readable: {type(e).__name__}") from e
