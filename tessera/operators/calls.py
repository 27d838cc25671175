"""Calls and integrations of Go, JavaScript, TypeScript, Vue and Ruby sources, found without a grammar.

Comments and strings are blanked first (strings keep their places, so that a topic can be read from them). A function
reaches from its name to the brace that closes its body, or in Ruby to the "end" at its own indentation; its calls are
the names in it that an opening bracket follows. Names and lines are those of the source; what a macro or a metaprogram
makes is not seen.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# Words that an opening bracket may follow without being called.
NO_CALLS = frozenset(
    """if for while switch catch return function func def class new await async typeof instanceof in of do else elsif unless until case when super
    yield import export require go defer select range make len cap append panic recover print println delete void with module end begin rescue
    ensure then not and or constructor""".split()
)
BRANCHES = frozenset("if for while switch catch function with return else do".split())
# Names of methods that send to a topic, listen to one, or ask an address.
PUBLISH = frozenset("publish send emit enqueue dispatch broadcast notify produce push perform_later perform_async sendtoqueue publishjson".split())
CONSUME = frozenset("subscribe consume on listen handlefunc queuesubscribe addlistener".split())
HTTP = frozenset("get post put patch delete head".split())
HTTP_CLIENTS = frozenset("axios http fetch request got client resty httpclient $http api faraday httparty".split())

_CURLY_NOISE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUBY_NOISE = re.compile(r"#[^\n{]*|^=begin\b.*?^=end\b|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S | re.M)
_GO_FUNCTION = re.compile(r"^func[ \t]+(?:\([^)]*\)[ \t]*)?([A-Za-z_]\w*)", re.M)
_JS_FUNCTION = re.compile(
    r"\bfunction\*?[ \t]+([A-Za-z_$][\w$]*)|\b(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)[^=\n;]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^()]*\)[^=\n]*=>|[A-Za-z_$][\w$]*[ \t]*=>)"
    r"|^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)[ \t]+)*([A-Za-z_$][\w$]*)[ \t]*\([^()\n]*\)[^;{}\n=]*\{",
    re.M,
)
_RUBY_FUNCTION = re.compile(r"^([ \t]*)def[ \t]+(?:self\.)?([A-Za-z_]\w*[?!=]?)", re.M)
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*[ \t]*\??\.[ \t]*)*)([A-Za-z_$][\w$]*[?!]?)[ \t]*\(")
_RUBY_SEND = re.compile(r"(?<![\w.:@$])(?:([A-Za-z_][\w:]*)\.)?([a-z_]\w*[?!]?)(?=[ \t]+[\"':@A-Za-z]|\()")
_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.S | re.I)
EXTENSIONS = (".go", ".js", ".jsx", ".ts", ".tsx", ".vue", ".rb")


def _blank(text: str, noise: re.Pattern) -> str:
    """The text with comments and what is within quotes as blanks; line ends stay."""

    def blank(m: re.Match) -> str:
        quoted = m[0][0] in "\"'`" and len(m[0]) > 1
        inside = re.sub(r"[^\n]", " ", m[0][1:-1] if quoted else m[0])
        return m[0][0] + inside + m[0][-1] if quoted else inside

    return noise.sub(blank, text)


def _lines(text: str):
    """A function from places to line numbers."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return lambda place: bisect_right(breaks, place - 1) + 1


def _functions(path: str, text: str, plain: str) -> list[tuple[str, int, int]]:
    """(name, begin, end of the body) of each function, in order of their beginnings."""
    out = []
    if path.endswith(".rb"):
        for m in _RUBY_FUNCTION.finditer(plain):
            close = re.compile(rf"^{re.escape(m[1])}end\b", re.M).search(plain, m.end())
            out.append((m[2], m.end(), close.start() if close else len(plain)))
        return out
    pattern = _GO_FUNCTION if path.endswith(".go") else _JS_FUNCTION
    opened: list[int] = []
    closing: dict[int, int] = {}
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            closing[opened.pop()] = m.start()
    braces = sorted(closing)
    for m in pattern.finditer(plain):
        name = next(g for g in m.groups() if g)
        if name in BRANCHES:
            continue
        at = bisect_right(braces, m.end() - 2 if m[0].endswith("{") else m.end() - 1)
        line_end = plain.find("\n", m.end())
        if at < len(braces) and (path.endswith(".go") or m[0].endswith("{") or line_end < 0 or braces[at] < line_end or "function" in m[0]):
            out.append((name, braces[at] + 1, closing[braces[at]]))
        else:
            out.append((name, m.end(), line_end if line_end >= 0 else len(plain)))
    return sorted(out, key=lambda f: f[1])


def _calls(path: str, plain: str):
    """(receiver, name, place after the opening of the arguments) of each call."""
    if path.endswith(".rb"):
        for m in _RUBY_SEND.finditer(plain):
            if m[2] not in NO_CALLS and not re.match(r"[ \t]*=", plain[m.end() : m.end() + 3]) and not re.search(r"\bdef[ \t]+(?:self\.)?$", plain[max(0, m.start() - 12) : m.start()]):
                yield m[1] or "", m[2], m.end()
        return
    for m in _CALL.finditer(plain):
        if m[2] not in NO_CALLS and not re.search(r"\b(?:function\*?|func)[ \t]*(?:\([^)]*\)[ \t]*)?$", plain[max(0, m.start() - 80) : m.start()]):
            yield re.sub(r"[ \t?]", "", m[1]).rstrip("."), m[2], m.end()


def edges_of(path: str, content: str | None) -> list[tuple[str, str, str, str, int]]:
    """calls edges of functions, and integration edges (PUBLISH t, CONSUME t, HTTP GET url), each once at its first line.

    Calls outside of functions belong to the file's <module> and count only as integrations. What is no literal is
    <var:...>. Empty and null contents have no edges; a file that does not end its braces keeps what came before.
    """
    text = content or ""
    if path.endswith(".vue"):
        found = _SCRIPT.search(text)
        text = "\n" * text.count("\n", 0, found.start(1)) + found[1] if found else ""
    plain = _blank(text, _RUBY_NOISE if path.endswith(".rb") else _CURLY_NOISE)
    line_of = _lines(text)
    functions = _functions(path, text, plain)
    out: dict[tuple[str, str, str], int] = {}
    open_: list[tuple[str, int]] = []
    following = iter([*functions, ("", len(plain) + 1, 0)])
    upcoming = next(following)
    for receiver, name, after in _calls(path, plain):
        while upcoming[1] <= after:
            open_.append((upcoming[0], upcoming[2]))
            upcoming = next(following)
        while open_ and open_[-1][1] < after:
            open_.pop()
        line = line_of(after)
        own = open_[-1][0] if open_ else "<module>"
        low, by = name.lower(), receiver.rpartition(".")[2].lower()
        argument = re.compile(r"[ \t(]*(?:[\w.]*[Cc](?:on)?te?xt?[ \t]*,[ \t]*)?([\"'`])([^\"'`\n]*)\1|[ \t(]*([^,()\n]*)").match(text, after)
        shown = argument[2] if argument[1] and "${" not in argument[2] and "#{" not in argument[2] else f"<var:{(argument[3] or argument[0]).strip()}>"
        target = None
        if low in HTTP and by in HTTP_CLIENTS:
            target = f"HTTP {name.upper()} {shown}"
        elif low == "fetch" and not receiver:
            target = f"HTTP GET {shown}"
        elif low in PUBLISH and receiver:
            target = f"PUBLISH {shown}" if low not in ("perform_later", "perform_async") else f"PUBLISH {receiver}"
        elif low in CONSUME and receiver:
            target = f"CONSUME {shown}"
        if target:
            out.setdefault((f"{path}::{own}", target, "integration"), line)
        if own != "<module>":
            out.setdefault((f"{path}::{own}", name, "calls"), line)
    return [(s, t, k, path, line) for (s, t, k), line in out.items()]


# --- routes that follow from the shape of a file ---

_RESOURCE = re.compile(r"^[ \t]*(resources?|namespace|scope|end|get|post|put|patch|delete|root|member|collection)\b[ \t]*(?:\(?[ \t]*[:\"']([\w/:.-]+)[\"']?)?([^\n]*)", re.M)
# The actions of a resource and of a single one, with their methods and paths.
PLURAL = (("index", "GET", ""), ("new", "GET", "/new"), ("create", "POST", ""), ("show", "GET", "/:id"), ("edit", "GET", "/:id/edit"), ("update", "PATCH", "/:id"), ("update", "PUT", "/:id"), ("destroy", "DELETE", "/:id"))
SINGLE = (("new", "GET", "/new"), ("create", "POST", ""), ("show", "GET", ""), ("edit", "GET", "/edit"), ("update", "PATCH", ""), ("update", "PUT", ""), ("destroy", "DELETE", ""))


def rails_routes(path: str, content: str | None) -> list[tuple[str, str, str, str, int]]:
    """http edges of a routes file: resources with only and except, nesting, namespaces, single verbs and the root."""
    text = re.sub(r"(^|\s)#[^\n]*", r"\1", content or "", flags=re.M)
    line_of = _lines(text)
    out: list[tuple[str, str, str, str, int]] = []
    stack: list[tuple[str, str, str]] = []  # kind, path prefix, module prefix

    def listed(option: str, rest: str) -> set[str] | None:
        m = re.search(rf"\b{option}:[ \t]*(?:%i\[([^\]]*)\]|\[([^\]]*)\]|:(\w+))", rest)
        return set(re.findall(r"\w+", next(g for g in m.groups() if g is not None))) if m else None

    for m in _RESOURCE.finditer(text):
        word, name, rest = m[1], m[2], m[3]
        line = line_of(m.start())
        prefix, module = (stack[-1][1], stack[-1][2]) if stack else ("", "")
        opens = bool(re.search(r"\bdo\b[ \t]*(?:\|[^|]*\|)?[ \t]*$", m[0]))
        if word == "end":
            if stack:
                stack.pop()
        elif word in ("resources", "resource") and name:
            controller = m2[1] if (m2 := re.search(r"controller:[ \t]*[:\"']([\w/]+)", rest)) else name if word == "resources" else f"{name}s"
            own = f"{prefix}/{m2[1].strip('/')}" if (m2 := re.search(r"\bpath:[ \t]*[\"']([^\"']*)", rest)) else f"{prefix}/{name}"
            only, skip = listed("only", rest), listed("except", rest) or set()
            for action, method, tail in PLURAL if word == "resources" else SINGLE:
                if (only is None or action in only) and action not in skip:
                    out.append((f"{method} {own}{tail}", f"{module}{controller}#{action}", "http", path, line))
            if opens:
                one = name[:-1] if name.endswith("s") else name
                stack.append((word, f"{own}/:{one}_id" if word == "resources" else own, module))
        elif word in ("namespace", "scope"):
            inner = f"{module}{m2[1]}/" if (m2 := re.search(r"module:[ \t]*[:\"']([\w/]+)", rest)) else f"{module}{name}/" if word == "namespace" and name else module
            stack.append((word, f"{prefix}/{name.strip('/')}" if name and not name.endswith(":") else prefix, inner))
        elif word in ("member", "collection"):
            base = re.sub(r"/:\w+_id$", "", prefix)
            stack.append((word, f"{base}/:id" if word == "member" else base, module))
        elif word == "root":
            if t := re.search(r"[\"'](\w[\w/]*#\w+)[\"']", m[0]):
                out.append((f"GET {prefix}/", f"{module}{t[1]}", "http", path, line))
        elif name:
            t = re.search(r"(?:to:|=>)[ \t]*[\"']([\w/]+#\w+)[\"']", rest)
            holder = stack[-1] if stack else None
            base = re.sub(r"/:\w+_id$", "", prefix) if holder and holder[0] == "resources" and "on:" in rest else prefix
            base += "/:id" if "on: :member" in rest else ""
            target = f"{module}{t[1]}" if t else f"{module}{re.sub(r'/:?(?:id)$', '', base).rpartition('/')[2]}#{name}"
            out.append((f"{word.upper()} {base}/{name.strip('/')}", target, "http", path, line))
        elif opens:
            stack.append((word, prefix, module))
    return out


def nuxt_routes(path: str) -> list[tuple[str, str, str, str, int]]:
    """http edges that a file's place gives: pages (GET) and server/api files (the method in their name, or ANY)."""
    if m := re.search(r"(?:^|/)pages/(.+)\.vue$", path):
        method, rest = "GET", m[1]
    elif m := re.search(r"(?:^|/)server/((?:api|routes)/.+?)(?:\.(get|post|put|patch|delete))?\.(?:ts|js)$", path):
        method, rest = (m[2] or "any").upper(), m[1].removeprefix("routes/")
    else:
        return []
    steps = [re.sub(r"^\[\.\.\.(\w*)\]$", lambda x: f"*{x[1]}", s) for s in rest.split("/")]
    steps = [re.sub(r"\[+(\w+)\]+", r":\1", re.sub(r"^_(\w+)$", r":\1", s)) for s in steps if s != "index"]
    return [(f"{method} /{'/'.join(steps)}", path, "http", path, 1)]


def grouped_routes(path: str, content: str | None) -> list[tuple[str, str, str, str, int]]:
    """http and middleware edges of Go routers: groups add their path to what is registered on them, Use guards their handlers."""
    text = _blank_comments(content or "")
    prefix: dict[str, str] = {}
    guards: dict[str, list[str]] = {}
    above: dict[str, str] = {}
    line_of = _lines(text)
    out: list[tuple[str, str, str, str, int]] = []
    step = re.compile(r"\b(\w+)[ \t]*:?=[ \t]*(\w+)\.Group\([ \t]*\"([^\"]*)\"([^)\n]*)\)|\b(\w+)\.Use\(([^\n]*)\)|\b(\w+)\.(GET|POST|PUT|PATCH|DELETE|Any)\([ \t]*\"([^\"]*)\"[ \t]*,[ \t]*([^\n]*)\)")
    names = lambda s: [x.rpartition(".")[2] for x in re.findall(r"[A-Za-z_][\w.]*(?=[ \t]*(?:,|$|\())", s)]
    for m in step.finditer(text):
        line = line_of(m.start())
        if m[1]:
            prefix[m[1]], above[m[1]] = prefix.get(m[2], "") + m[3], m[2]
            guards[m[1]] = [*guards.get(m[2], []), *names(m[4])]
        elif m[5]:
            guards.setdefault(m[5], []).extend(names(m[6]))
        else:
            called = names(m[10])
            if not called:
                continue
            handler, own = (called[-1], called[:-1]) if "gin" in text else (called[0], called[1:])
            out.append((f"{m[8].upper()} {prefix.get(m[7], '')}{m[9]}", handler, "http", path, line))
            out += [(g, handler, "middleware", path, line) for g in dict.fromkeys([*guards.get(m[7], []), *own])]
    return out


def _blank_comments(text: str) -> str:
    return re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def express_routes(path: str, content: str | None) -> list[tuple[str, str, str, str, int]]:
    """http and middleware edges of app.get("/p", guard, handler) and of router.use(guard); a handler without a name is <inline>."""
    text = _blank_comments(content or "")
    line_of = _lines(text)
    out: list[tuple[str, str, str, str, int]] = []
    guards: dict[str, list[str]] = {}
    for m in re.finditer(r"\b(app|router|\w*[rR]outer)\.(use|get|post|put|patch|delete|all)\([ \t]*(?:(['\"`])([^'\"`\n]*)\3[ \t]*,?)?([^\n]*)", text):
        line = line_of(m.start())
        begun = re.search(r"\(|\bfunction\b|\basync\b|=>", m[5])  # where a handler without a name begins
        called = [x.rpartition(".")[2] for x in re.findall(r"(?:^|,)[ \t]*([A-Za-z_$][\w$.]*)[ \t]*(?=,|\)|$)", m[5][: begun.start()] if begun else m[5])]
        if m[2] == "use":
            guards.setdefault(m[1], []).extend(called if m[4] is None else [])
            continue
        if m[4] is None:
            continue
        inline = bool(re.search(r"=>|\bfunction\b", m[5]))
        handler = "<inline>" if inline or not called else called[-1]
        own = called if inline else called[:-1]
        method = "ANY" if m[2] == "all" else m[2].upper()
        out.append((f"{method} {m[4] or '/'}", handler, "http", path, line))
        out += [(g, handler, "middleware", path, line) for g in dict.fromkeys([*guards.get(m[1], []), *own])]
    return out


def nest_routes(path: str, content: str | None) -> list[tuple[str, str, str, str, int]]:
    """http edges of controllers: the class's path before the method's, the handler is Class.method."""
    text = _blank_comments(content or "")
    line_of = _lines(text)
    out: list[tuple[str, str, str, str, int]] = []
    base, owner = "", ""
    for m in re.finditer(r"@Controller\([ \t]*(?:['\"]([^'\"]*)['\"])?[^)]*\)|\bclass[ \t]+(\w+)|@(Get|Post|Put|Patch|Delete|All)\([ \t]*(?:['\"]([^'\"]*)['\"])?[ \t]*\)", text):
        if m[0].startswith("@Controller"):
            base = (m[1] or "").strip("/")
        elif m[2]:
            owner = m[2]
        else:
            name = re.compile(r"(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:(?:public|private|protected|async|static)\s+)*([A-Za-z_$][\w$]*)\s*\(").match(text, m.end())
            if name:
                whole = "/".join(x for x in (base, (m[4] or "").strip("/")) if x)
                out.append((f"{'ANY' if m[3] == 'All' else m[3].upper()} /{whole}", f"{owner}.{name[1]}", "http", path, line_of(m.start())))
    return out
