"""Facts of a PHP file: classes, methods, properties, routes, and what methods do with request data.

Everything that needs the tree of one file happens here, once per file; what
needs other files is a join over the tables that come out.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry import registry as R
from codequarry.php.lexer import PhpError
from codequarry.php.parser import Node, parse

FULL, PATH, UNKNOWN, TRUSTED = ("tainted", "full"), ("tainted", "path"), ("unknown", ""), ("trusted", "")
_RANK = {FULL: 3, PATH: 2, UNKNOWN: 1, TRUSTED: 0}
FIND = {"find", "findorfail", "findor", "findornew", "findmany"}
FIRST = {"first", "firstorfail", "firstwhere", "sole", "get", "value"}
WRITES = {"update", "delete", "forcedelete", "forcefill", "save", "fill"}
HTTP_CLASSES = ("Illuminate\\Support\\Facades\\Http", "Http", "GuzzleHttp\\Client", "Client")
HTTP_VERBS = {"get", "post", "put", "patch", "delete", "head", "request", "send", "async"}
URL_FUNCTIONS = {"curl_init": 0, "file_get_contents": 0, "fopen": 0, "get_headers": 0}
FILL_METHODS = {"create", "update", "fill", "forcefill", "updateorcreate", "firstorcreate", "insert", "make"}
STOPS = {"abort", "abort_if", "abort_unless", "throw_if", "throw_unless"}
OWNER_COLUMNS = set(R.OWNERSHIP_FIELDS)
SCALARS = {"int", "string", "float", "bool", "mixed", "array"}


def worst(items):
    return max(items, key=_RANK.__getitem__, default=UNKNOWN)


def chain(e: Node) -> tuple[Node, list]:
    """(root, calls from the root outwards) of a call chain."""
    calls = []
    while e.kind in ("method_call", "prop_fetch"):
        calls.append(e)
        e = e.on
    return e, calls[::-1]


def strings(e: Node | None) -> list[str]:
    """String values directly in an array literal (or one string)."""
    if e is None:
        return []
    if e.kind == "string":
        return [e.value]
    if e.kind == "array":
        return [i.value.value for i in e.f["items"] if i.value.kind == "string"]
    return []


def pairs(e: Node | None) -> dict:
    return {i.key.value: i.value.value if i.value.kind == "string" else "" for i in e.f["items"] if i.key is not None and i.key.kind == "string"} if e is not None and e.kind == "array" else {}


def label(e: Node) -> str:
    """What an expression is called: its variable, property, key or first string argument."""
    if e.kind in ("cast", "unary"):
        return label(e.e)
    if e.kind == "var":
        return e.name
    if e.kind == "prop_fetch":
        return e.name or ""
    if e.kind == "index":
        return e.key.value if e.key is not None and e.key.kind == "string" else label(e.on)
    if e.kind in ("method_call", "static_call", "call") and e.args:
        first = e.args[0].e
        if first.kind == "string":
            return first.value
        return label(first) if e.kind == "call" else ""
    return ""


class Method:
    """Request data and guards within one method, read once in source order."""

    def __init__(self, cls: Node, m: Node, controller: bool):
        self.cls, self.m = cls, m
        self.vars: dict = {}
        self.requests, self.models, self.origin = set(), {}, {}
        for p in m.params:
            short = (p.type or "").split("\\")[-1]
            if short.endswith("Request"):
                self.requests.add(p.name)
            elif p.type is None or p.type.lower() in SCALARS:
                self.vars[p.name] = (FULL if controller else UNKNOWN, f"route parameter ${p.name}")
            else:
                self.models[p.name] = p.type
                self.vars[p.name] = (UNKNOWN, "")
        self.guarded = False
        self.rows: list[dict] = []
        self.returned: list[Node] = []
        self.url_checked: set = set()
        self.rules: dict = {}
        self.reassigned: set = set()
        for s in m.body or []:
            self.visit(s)
        self.finish()

    # --- trust

    def is_request(self, e: Node) -> bool:
        return (e.kind == "var" and e.name in self.requests) or (e.kind == "call" and e.name.lower() == "request" and not e.args)

    def is_user(self, e: Node) -> bool:
        """The signed-in user, or something of theirs."""
        root, calls = chain(e)
        names = [(c.name or "").lower() for c in calls]
        if root.kind == "static_call" and root.cls.kind == "class_name" and root.cls.name.split("\\")[-1] == "Auth":
            return True
        if root.kind == "call" and root.name.lower() == "auth":
            return True
        return self.is_request(root) and bool(names) and names[0] == "user" or (root.kind == "var" and self.origin.get(root.name) == "user")

    def judge(self, e: Node | None, depth=0):
        """((trust, reach), where it came from)."""
        if e is None or depth > 12:
            return UNKNOWN, ""
        k = e.kind
        if k in ("string", "number", "constant", "class_const", "class_name"):
            return TRUSTED, ""
        if self.is_user(e):
            return TRUSTED, ""
        if k == "var":
            if e.name in R.SUPERGLOBALS:
                return FULL, f"${e.name}"
            if e.name in self.requests:
                return FULL, "request"
            return self.vars.get(e.name, (UNKNOWN, ""))
        if k == "index":
            return self.judge(e.on, depth + 1)
        if k == "prop_fetch":
            if self.is_request(e.on):
                return (UNKNOWN, "") if e.name in ("attributes", "session", "userResolver", "routeResolver") else (FULL, f"request property {e.name}")
            return self.judge(e.on, depth + 1) if self.judge(e.on, depth + 1)[0] == TRUSTED else (UNKNOWN, "")
        if k == "method_call":
            name = (e.name or "").lower()
            if self.is_request(e.on):
                if name in R.VALIDATED_ACCESSORS:
                    return FULL, "validated input"
                if name in R.TAINTED_ACCESSORS:
                    return FULL, f"request {name}"
                return (TRUSTED, "") if name in R.TRUSTED_ACCESSORS else (UNKNOWN, "")
            on = self.judge(e.on, depth + 1)
            return on if on[0] in (FULL, TRUSTED) and name in ("only", "except", "all", "toarray", "get", "tostring", "lower", "trim", "value") else (UNKNOWN, "")
        if k == "call":
            name = e.name.lower().split("\\")[-1]
            args = [a.e for a in e.args]
            if name in ("request", "input") and args:
                return FULL, f"request {label(e)}"
            if name in R.TAINTED_FUNCTIONS:
                return FULL, name
            if name in R.TRUSTED_FUNCTIONS:
                return TRUSTED, ""
            if name in R.PRESERVING_FUNCTIONS:
                got = [self.judge(a, depth + 1) for a in args]
                return max(got, key=lambda x: _RANK[x[0]], default=(UNKNOWN, ""))
            return UNKNOWN, ""
        if k in ("template", "binary"):
            if k == "binary" and e.op not in (".", "??", "+"):
                return TRUSTED, ""
            parts = e.parts if k == "template" else self.concat(e) if e.op == "." else [e.left, e.right]
            got = [self.judge(p, depth + 1) for p in parts]
            top = max(got, key=lambda x: _RANK[x[0]], default=(UNKNOWN, ""))
            if top[0] == FULL and (k == "template" or e.op == "."):
                lead = ""
                for p, (j, _) in zip(parts, got):
                    if j[0] == "tainted":
                        break
                    lead += p.value if p.kind == "string" else "x"
                if re.match(r"https?://[^/?#]+[/?#]", lead) and parts[0].kind == "string":
                    return PATH, top[1]
            return top
        if k == "ternary":
            return max([self.judge(x, depth + 1) for x in (e.then or e.cond, e.other)], key=lambda x: _RANK[x[0]])
        if k in ("cast", "unary"):
            return self.judge(e.e, depth + 1)
        if k == "array":
            return max([self.judge(i.value, depth + 1) for i in e.f["items"]], key=lambda x: _RANK[x[0]], default=(TRUSTED, ""))
        if k == "match":
            return max([self.judge(a.e, depth + 1) for a in e.arms], key=lambda x: _RANK[x[0]], default=(UNKNOWN, ""))
        if k == "assign":
            return self.judge(e.value, depth + 1)
        return UNKNOWN, ""

    def concat(self, e):
        if e.kind == "binary" and e.op == ".":
            return self.concat(e.left) + self.concat(e.right)
        return [e]

    # --- one pass

    def visit(self, n: Node, conditional=False):
        k = n.kind
        if k in ("closure", "class", "function"):
            if k == "closure":
                for s in n.body or []:
                    self.visit(s, True)
            return
        if k in ("if", "loop", "foreach", "switch", "try", "ternary", "match"):
            conditional = True
        if k == "foreach" and n.value is not None and n.value.kind == "var":
            self.vars[n.value.name] = self.judge(n.over)
        for c in n.children():
            self.visit(c, conditional)
        if k == "assign" and n.to.kind == "var":
            self.assign(n, conditional)
        elif k == "return" and n.e is not None:
            self.returned.append(n.e)
        elif k == "throw" or (k == "word" and n.word == "throw"):
            if n.e is not None and n.e.kind == "new" and n.e.cls is not None and n.e.cls.kind == "class_name" and re.search("Authorization|AccessDenied|Forbidden|Unauthorized", n.e.cls.name):
                self.guarded = True
        elif k == "binary" and n.op in ("==", "!=", "===", "!==") and (self.is_user(n.left) or self.is_user(n.right)):
            self.guarded = True
        elif k in ("method_call", "static_call", "call"):
            self.called(n)

    def assign(self, n, conditional):
        name, (trust, source) = n.to.name, self.judge(n.value)
        if name in self.models:
            self.reassigned.add(name)
        if n.op == ".=" and name in self.vars:
            trust = worst([trust, self.vars[name][0]])
            source = source or self.vars[name][1]
        elif conditional and name in self.vars and _RANK[self.vars[name][0]] > _RANK[trust]:
            trust, source = self.vars[name]
        self.vars[name] = (trust, source)
        root, calls = chain(n.value)
        self.origin[name] = "user" if self.is_user(n.value) and any((c.name or "").lower() == "user" for c in calls) or (root.kind == "static_call" and (root.name or "").lower() == "user") else n.value

    def called(self, n):
        name = (n.name or "").lower()
        lower = name.split("\\")[-1]
        args = [a.e for a in n.args]
        if n.kind != "call" and (name in R.AUTHORIZATION_METHODS or any(f in name for f in R.AUTHORIZATION_FRAGMENTS)):
            self.guarded = True
        if n.kind == "static_call" and n.cls.kind == "class_name" and n.cls.name.split("\\")[-1] == "Gate":
            self.guarded = True
        if n.kind == "call" and lower in STOPS:
            self.guarded = self.guarded or lower != "abort" or any(a.kind == "number" and a.value in ("401", "403") for a in args)
        if lower in ("validate", "make") and args and n.kind != "call":
            for a in args:
                self.rules.update(pairs(a))
        if lower in ("in_array", "filter_var", "parse_url", "str_starts_with", "preg_match"):
            for a in args:
                self.url_checked.update(x.name for x in a.walk() if x.kind == "var")
        self.fetch(n)
        self.sink(n, lower, args)

    def fetch(self, n):
        root, calls = chain(n)
        if root.kind != "static_call" or root.cls.kind != "class_name" or root.cls.name.lower() in ("self", "static", "parent"):
            return
        names = [(root.name or "").lower()] + [(c.name or "").lower() for c in calls]
        all_args = [root.args] + [c.get("args") or [] for c in calls]
        last, keys = names[-1], None
        if last in FIND and all_args[-1]:
            keys = all_args[-1][0].e
        elif last in FIRST:
            for nm, ar in zip(names, all_args):
                if nm in ("where", "firstwhere") and len(ar) > 1 and ar[0].e.kind == "string" and ar[0].e.value.split(".")[-1] == "id":
                    keys = ar[-1].e
        elif last == "destroy" and all_args[-1]:
            keys = all_args[-1][0].e
        if keys is None:
            return
        columns = [a[0].e.value for nm, a in zip(names, all_args) if nm.startswith(("where", "orwhere")) and a and a[0].e.kind == "string"]
        columns += [re.sub(r"(?<!^)(?=[A-Z])", "_", (c.name or "")[5:]).lower() for c in [root, *calls] if (c.name or "").startswith("where") and len(c.name or "") > 5]
        (trust, reach), source = self.judge(keys)
        self.rows.append({"kind": "mutation" if last == "destroy" else "fetch", "line": n.line, "model": root.cls.name, "label": label(keys), "trust": trust, "reach": reach, "source": source, "columns": columns, "responds": last == "destroy", "expr": n, "detail": last})

    def sink(self, n, name, args):
        if n.kind == "call" and name in URL_FUNCTIONS and args:
            self.url_sink(n, args[URL_FUNCTIONS[name]], name)
        if n.kind == "call" and name == "curl_setopt" and len(args) > 2 and args[1].kind == "constant" and args[1].name == "CURLOPT_URL":
            self.url_sink(n, args[2], name)
        if n.kind in ("method_call", "static_call") and name in HTTP_VERBS and args:
            root, calls = chain(n)
            http = root.kind == "static_call" and root.cls.kind == "class_name" and root.cls.name in HTTP_CLASSES
            held = root.kind == "var" and isinstance(o := self.origin.get(root.name), Node) and o.kind == "new" and o.cls is not None and o.cls.kind == "class_name" and o.cls.name in HTTP_CLASSES
            fresh = root.kind == "new" and root.cls is not None and root.cls.kind == "class_name" and root.cls.name in HTTP_CLASSES
            if http or held or fresh:
                self.url_sink(n, args[1] if name == "request" and len(args) > 1 else args[0], name)
        if n.kind in ("method_call", "static_call") and name in FILL_METHODS and args:
            for a in args:
                reach = self.reach(a)
                if reach:
                    root, _ = chain(n)
                    model = root.cls.name if root.kind == "static_call" and root.cls.kind == "class_name" else self.model_of(root)
                    if model:
                        self.rows.append({"kind": "fill", "line": n.line, "model": model, "label": "", "trust": "tainted", "reach": "full", "source": "request", "columns": reach[1], "responds": False, "expr": n, "detail": reach[0]})

    def url_sink(self, n, e, name):
        (trust, reach), source = self.judge(e)
        used = {x.name for x in e.walk() if x.kind == "var"}
        held = bool(used & self.url_checked) or any(re.search(r"\b(?:url|active_url|in:)", v) for k, v in self.rules.items() if k in source or k == label(e))
        self.rows.append({"kind": "url", "line": n.line, "model": "", "label": label(e), "trust": trust, "reach": reach, "source": source, "columns": ["checked"] if held else [], "responds": False, "expr": n, "detail": name})

    def reach(self, e):
        """(kind, fields) of request data passed wholesale, else None."""
        if e.kind == "var" and isinstance(self.origin.get(e.name), Node):
            return self.reach(self.origin[e.name])
        root, calls = chain(e)
        if not self.is_request(root) or not calls or any(c.kind != "method_call" for c in calls):
            return None
        kind, fields = "all", []
        for c in calls:
            name, given = (c.name or "").lower(), [s for a in c.args for s in strings(a.e)]
            if name in ("validated", "safe", "validate"):
                return None
            if name == "only":
                kind, fields = "only", given if kind == "all" else [x for x in given if (x in fields) == (kind == "only")]
            elif name == "except":
                kind, fields = ("only", [x for x in fields if x not in given]) if kind == "only" else ("except", fields + given)
            elif name not in ("all", "toarray", "collect", "input", "post"):
                return None
            elif name in ("input", "post") and c.args:
                return None
        return kind, fields

    def model_of(self, e):
        if e.kind == "var":
            if e.name in self.models:
                return self.models[e.name]
            o = self.origin.get(e.name)
            if isinstance(o, Node):
                root, _ = chain(o)
                if root.kind == "static_call" and root.cls.kind == "class_name":
                    return root.cls.name
                if root.kind == "new" and root.cls is not None and root.cls.kind == "class_name":
                    return root.cls.name
        return None

    def finish(self):
        inside = {id(x) for r in self.returned for x in r.walk()}
        shown = {x.name for r in self.returned for x in r.walk() if x.kind == "var"} | {s for r in self.returned for x in r.walk() if x.kind == "call" and x.name == "compact" for a in x.args for s in strings(a.e)}
        for r in self.rows:
            if r["kind"] == "fetch":
                names = {v for v, o in self.origin.items() if isinstance(o, Node) and any(x is r["expr"] for x in o.walk())}
                r["responds"] = id(r["expr"]) in inside or bool(names & shown)
                written = [x for s in self.m.body or [] for x in s.walk() if x.kind == "method_call" and (x.name or "").lower() in WRITES and (root := chain(x)[0]).kind == "var" and root.name in names]
                if written:
                    r["kind"], r["detail"], r["line"] = "mutation", written[0].name, written[0].line
        for p in self.m.params:
            if p.name in self.models and p.name not in self.reassigned and p.default is None:
                written = [x for s in self.m.body or [] for x in s.walk() if x.kind == "method_call" and (x.name or "").lower() in WRITES and chain(x)[0].kind == "var" and chain(x)[0].name == p.name]
                if written or p.name in shown:
                    self.rows.append({"kind": "binding", "line": (written[0] if written else self.m).line, "model": p.type, "label": p.name, "trust": "tainted", "reach": "full", "source": "route binding", "columns": [], "responds": p.name in shown, "expr": None, "detail": written[0].name if written else "returned"})
        for e in self.returned:
            for x in e.walk():
                if x.kind == "prop_fetch" and x.name and x.on.kind in ("var", "prop_fetch", "method_call"):
                    wrapped = any(y.kind == "method_call" and (y.name or "").lower() == "when" and x in list(y.walk()) for y in e.walk())
                    own = self.is_user(x.on) or (x.on.kind == "var" and x.on.name == "this")
                    self.rows.append({"kind": "expose", "line": x.line, "model": self.model_of(x.on) or "", "label": x.name, "trust": "", "reach": "", "source": "", "columns": [*(["when"] if wrapped else []), *(["self"] if own else [])], "responds": True, "expr": None, "detail": "return"})


def _routes(statements: list[Node], path: str) -> list[dict]:
    out: list[dict] = []

    def value(e):
        return e.value if e is not None and e.kind == "string" else ""

    def action(e):
        if e.kind == "array" and len(e.f["items"]) == 2:
            c, m = (i.value for i in e.f["items"])
            if c.kind == "class_const" and m.kind == "string":
                return c.cls.name, m.value
        if e.kind == "class_const" and e.name == "class":
            return e.cls.name, "__invoke"
        if e.kind == "string":
            c, at, m = e.value.partition("@")
            return (c if at else ""), (m if at else e.value)
        return None, None

    def walk(nodes, prefix, middleware, controller):
        for n in nodes:
            if n.kind in ("block",):
                walk(n.body, prefix, middleware, controller)
                continue
            if n.kind in ("if", "foreach"):
                walk([*n.get("then", []), *n.get("other", []), *n.get("body", [])], prefix, middleware, controller)
                continue
            if n.kind != "expr" or n.e.kind not in ("static_call", "method_call"):
                continue
            root, calls = chain(n.e)
            if root.kind != "static_call" or root.cls.kind != "class_name" or root.cls.name.split("\\")[-1] != "Route":
                continue
            steps = [((c.name or "").lower(), [a.e for a in c.args or []]) for c in [root, *[c for c in calls if c.kind == "method_call"]]]
            mw, pre, ctl = list(middleware), prefix, controller
            for name, args in steps:
                if name == "middleware":
                    mw += [s for a in args for s in strings(a)]
                elif name == "prefix" and args:
                    pre = f"{pre}/{value(args[0]).strip('/')}"
                elif name == "controller" and args and args[0].kind == "class_const":
                    ctl = args[0].cls.name
                elif name == "group" and args:
                    options = args[0] if args[0].kind == "array" else None
                    if options is not None:
                        for i in options.f["items"]:
                            if value(i.key) == "middleware":
                                mw += strings(i.value)
                            if value(i.key) == "prefix":
                                pre = f"{pre}/{value(i.value).strip('/')}"
                    body = args[-1]
                    if body.kind == "closure":
                        walk(body.body, pre, mw, ctl)
            name, args = steps[0]
            head = next(((n2, a2) for n2, a2 in steps if n2 in ("get", "post", "put", "patch", "delete", "options", "any", "match", "resource", "apiresource", "view", "redirect")), (name, args))
            name, args = head
            if name in ("get", "post", "put", "patch", "delete", "options", "any", "match") and len(args) > 1:
                uri = args[1] if name == "match" else args[0]
                c, m = action(args[-1] if name == "match" else args[1])
                if m and (c or ctl):
                    verbs = ["GET", "POST", "PUT", "PATCH", "DELETE"] if name == "any" else [v.upper() for v in strings(args[0])] if name == "match" else [name.upper()]
                    for v in verbs:
                        out.append({"path": path, "line": n.line, "verb": v, "uri": "/" + f"{pre}/{value(uri).strip('/')}".strip("/"), "class": c or ctl, "method": m, "middleware": list(dict.fromkeys(mw))})
            elif name in ("resource", "apiresource") and len(args) > 1 and args[1].kind == "class_const":
                only = next((strings(a[0]) for s, a in steps if s == "only" and a), None)
                but = next((strings(a[0]) for s, a in steps if s == "except" and a), [])
                base = value(args[0]).strip("/")
                p = re.sub("(?<=.)s$", "", base.split("/")[-1])
                for m, verb, tail in R.RESOURCE_ROUTES:
                    if (name == "apiresource" and m in ("create", "edit")) or (only is not None and m not in only) or m in but:
                        continue
                    out.append({"path": path, "line": n.line, "verb": verb, "uri": "/" + f"{pre}/{base}{tail.replace('{p}', '{' + p + '}')}".strip("/"), "class": args[1].cls.name, "method": m, "middleware": list(dict.fromkeys(mw))})

    walk(statements, "", [], None)
    return out


def extract(path: str, code: str) -> list[tuple[str, dict]]:
    """(table, row) facts of one file."""
    try:
        tree = parse(code)
    except PhpError as e:
        return [("errors", {"path": path, "reason": str(e)})]
    out: list[tuple[str, dict]] = [("routes", r) for r in _routes(tree, path)]
    for top in tree:
        for c in top.walk(lambda n: n.kind not in ("method", "closure")):
            if c.kind != "class" or not c.name:
                continue
            short = c.name
            controller = short.endswith("Controller") or bool(c.parent and c.parent.endswith("Controller"))
            lists = {p.name: strings(p.value) for p in c.props if p.value is not None}
            casts = next((pairs(p.value) for p in c.props if p.name == "casts"), {})
            words = {x.value for m in c.methods for x in m.walk() if x.kind == "string"} | {s for v in lists.values() for s in v}
            names = {m.name.lower() for m in c.methods}
            source = {x.name.split("\\")[-1] for m in c.methods for x in m.walk() if x.kind == "class_name"}
            calls = {(x.name or "").lower() for m in c.methods for x in m.walk() if x.kind in ("static_call", "method_call")}
            out.append(("classes", {
                "path": path, "fqcn": c.fqcn, "short": short, "type": c.f["type"], "parent": c.parent, "interfaces": c.interfaces, "traits": c.traits, "abstract": c.abstract, "line": c.line, "end_line": c.end,
                "fillable": lists.get("fillable"), "fillable_lines": [i.value.line for p in c.props if p.name == "fillable" and p.value is not None and p.value.kind == "array" for i in p.value.f["items"] if i.value.kind == "string"], "guarded": lists.get("guarded"), "hidden": lists.get("hidden"), "casts": casts, "owner": bool(words & OWNER_COLUMNS) or "User" in source,
                "scoped": "addglobalscope" in calls, "authorizes": bool(calls & {"authorizeresource"}) or any(s.startswith(("can:", "role:", "permission:")) for s in words), "bound": bool(names & {"resolveroutebinding", "getroutekeyname", "resolvechildroutebinding"}), "has_middleware": "middleware" in names,
            }))
            for m in c.methods:
                seen = Method(c, m, controller and m.visibility == "public" and m.name != "__construct")
                literal = len(m.body or []) == 1 and m.body[0].kind == "return" and m.body[0].e is not None and m.body[0].e.kind == "constant" and m.body[0].e.name.lower() == "true"
                out.append(("methods", {"path": path, "class": c.fqcn, "method": m.name, "visibility": m.visibility, "static": m.static, "abstract": m.abstract, "line": m.line, "end_line": m.end, "guarded": seen.guarded, "helpers": sorted({x.name.lower() for x in m.walk() if x.kind == "method_call" and x.name and x.on.kind == "var" and x.on.name == "this"}), "always_true": literal, "params": [{"name": p.name, "type": p.type, "optional": p.default is not None} for p in m.params]}))
                for r in seen.rows:
                    out.append(("uses", {"path": path, "class": c.fqcn, "method": m.name, **{k: v for k, v in r.items() if k != "expr"}}))
                touched = [p.type for p in m.params if p.type] + [n.cls.name for n in m.walk() if n.kind in ("static_call", "new") and n.get("cls") is not None and n.cls.kind == "class_name"]
                for name in dict.fromkeys(touched):
                    out.append(("touches", {"path": path, "class": c.fqcn, "method": m.name, "model": name}))
                for n in m.walk(lambda n: n.kind not in ("closure", "class", "function", "arrow")):
                    if n.kind == "assign" and n.to.kind == "var":
                        out.append(("assignments", {"path": path, "class": c.fqcn, "method": m.name, "name": n.to.name, "line": n.line, "append": n.op == ".=", "iterated": False}))
                    elif n.kind == "foreach" and n.value is not None and n.value.kind == "var":
                        out.append(("assignments", {"path": path, "class": c.fqcn, "method": m.name, "name": n.value.name, "line": n.line, "append": False, "iterated": True}))
    return out


TABLES = {
    "errors": "path string, reason string",
    "classes": "path string, fqcn string, short string, type string, parent string, interfaces array<string>, traits array<string>, abstract boolean, line int, end_line int, fillable array<string>, fillable_lines array<int>, guarded array<string>, hidden array<string>, casts map<string,string>, owner boolean, scoped boolean, authorizes boolean, bound boolean, has_middleware boolean",
    "methods": "path string, class string, method string, visibility string, static boolean, abstract boolean, line int, end_line int, guarded boolean, helpers array<string>, always_true boolean, params array<struct<name:string,type:string,optional:boolean>>",
    "uses": "path string, class string, method string, kind string, line int, model string, label string, trust string, reach string, source string, columns array<string>, responds boolean, detail string",
    "touches": "path string, class string, method string, model string",
    "routes": "path string, line int, verb string, uri string, class string, method string, middleware array<string>",
    "assignments": "path string, class string, method string, name string, line int, append boolean, iterated boolean",
}


def facts(files: DataFrame) -> DataFrame:
    """(table, row as JSON) of source files (path, content): one parse a file, no shuffle."""

    def run(batches):
        for b in batches:
            rows = [(t, json.dumps(r)) for p, c in zip(b["path"], b["content"]) for t, r in extract(p, c or "")]
            yield pd.DataFrame(rows, columns=["table", "row"])

    return files.select("path", "content").mapInPandas(run, "table string, row string")


class Facts:
    """The fact tables of a corpus. The parsed rows are kept, as every detector reads them."""

    def __init__(self, files: DataFrame):
        self.files = files
        self.rows = facts(files).persist()

    def table(self, name: str) -> DataFrame:
        return self.rows.where(F.col("table") == name).select(F.from_json("row", TABLES[name]).alias("r")).select("r.*")

    def __getattr__(self, name):
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)
