"""Lexers for Python, TypeScript, JavaScript, Java, Go and JSON that turn a file into a string of token classes.

One regular expression per language cuts the text into tokens; a table maps each token to one character, so that
the following steps (a pushdown over brackets, grammars, repetition) run over short strings. Comments and blanks
get no character. `X` marks what no token may be: an unterminated literal or comment, a stray character, or a
merge-conflict marker outside of literals.
"""

from __future__ import annotations

import re
from functools import cache

MARKER = r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \t\r\n]|\Z)"
_DQ = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
_SQ = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_NUMBER = r"\.?\d(?:[eEpP][+-]|[\w.])*"
_TEMPLATE = r"`[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})[^`\\$]*)*`"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"

#: The words of the languages by the part they play; see `_classes`.
_SCRIPT_WORDS = {
    "f": "function", "C": "class", "g": "if", "k": "while for with", "r": "switch", "h": "catch", "e": "else", "y": "try", "q": "do", "z": "finally", "a": "case", "W": "return throw", "w": "typeof void delete new await",
    "b": "in instanceof", "d": "const", "v": "let var", "I": "import", "x": "export", "D": "default", "j": "break continue debugger", "p": "extends",
    "c": "async of get set static from as yield",
}
_TYPED_WORDS = _SCRIPT_WORDS | {
    "C": "class interface enum namespace", "p": "extends implements",
    "c": "async of get set static from as yield type declare abstract readonly public private protected override is keyof infer satisfies asserts unique module",
}
_JAVA_WORDS = {
    "m": "public private protected static final abstract native transient volatile strictfp sealed", "C": "class interface enum record",
    "g": "if", "k": "while for synchronized", "r": "switch", "h": "catch", "e": "else", "y": "try", "q": "do", "z": "finally", "a": "case", "W": "return throw", "w": "new assert", "b": "instanceof", "I": "import",
    "T": "int long short byte char double float boolean", "Y": "yield",
    "G": "package", "j": "break continue", "p": "extends implements throws permits", "D": "default",
}
_GO_WORDS = {
    "f": "func", "G": "package", "I": "import", "v": "var const", "t": "type", "k": "if for switch select", "e": "else", "w": "return go defer range",
    "S": "struct interface", "M": "map chan", "j": "break continue fallthrough goto", "D": "default", "c": "case",
}
_PYTHON_WORDS = {"k": "if while for with elif except", "e": "else try finally", "f": "def", "C": "class", "w": "return raise yield await assert del", "I": "import from"}

#: Statement words by the wider classes that most rules and the grammars of `provenance` know.
COARSE = str.maketrans("grhyqzaTW", "kkkeeewiw")

_OPERATORS = {
    "++": "u", "--": "u", "!": "~", "~": "~", "=>": "A", "->": "A", "...": "E", "@": "@", "?.": "Q", "::": ".", ".": ".", ":": ":", "?": "?", ";": ";", ",": ",",
    "<": "<", ">": ">", "+": "+", "-": "+", "*": "*", "|": "|", "&": "|", "=": "=", ":=": "=", "\n": "\n",
    **dict.fromkeys("+= -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= &^=".split(), "="),
    **dict.fromkeys("/ % ** ^ && || ?? == === != !== <= >= << &^ <-".split(), "o"), **{b: b for b in "()[]{}"},
}


class _Classes(dict):
    """Token to class; tokens not seen before are classified by their first character."""

    def __init__(self, words: dict[str, str], extra: dict[str, str]) -> None:
        super().__init__(_OPERATORS)
        self.template = extra.pop("`", "s")
        self.update({word: kind[0] for kind, names in words.items() for word in names.split()})
        self.update(extra)
        self.fixed = len(self)

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            for key in list(self)[self.fixed :]:
                del self[key]
        first = token[0]
        if token.startswith(("//", "/*", "#!", "# ")) or first == "\\" and token[1:2] in "\r\n":
            kind = ""
        elif first == "`" and len(token) > 1:
            kind = self.template
        elif (first.isalpha() or first == "=") and token[-1] not in "\"'" and "/" in token:
            kind = self[token[: token.index("/")].rstrip()] + "s"
        elif first.isalpha() or first in "_$" or first == "#" and len(token) > 1 and (token[1].isalpha() or token[1] in "_$"):
            kind = "s" if token[-1] in "\"'" else "i"
        elif first.isdigit() or first in ".-" and token[1:2].isdigit():
            kind = "n"
        elif first in "\"'" and len(token) > 1:
            kind = "s"
        elif first == "#":
            kind = "" if len(token) > 1 else "X"
        elif len(token) > 1 and "/" in token and first in _OPERATORS:
            kind = _OPERATORS[first] + "s"
        else:
            kind = "X"
        self[token] = kind
        return kind


class Lexer:
    def __init__(self, pattern: str, words: dict[str, str], lines: bool, extra: dict[str, str] | None = None) -> None:
        end = r"|\n" if lines else ""
        self.tokens = re.compile(rf"(?m){MARKER}|{pattern}{end}|\S").findall
        self.classes = _Classes(words, extra or {})

    def fine(self, text: str) -> str:
        """The classes of all tokens, with statement words told apart."""
        return "".join(map(self.classes.__getitem__, self.tokens(text)))

    def kinds(self, text: str) -> str:
        return self.fine(text).translate(COARSE).replace("Y", "i")


_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")


class Script(Lexer):
    """A lexer with a second mode: what stands in the `${}` of a template is code again, to any depth."""

    def __init__(self, pattern: str, words: dict[str, str], extra: dict[str, str]) -> None:
        super().__init__(pattern, words, True, extra | {"`": "P"})
        self.step = re.compile(rf"(?m){MARKER}|{pattern.replace(_TEMPLATE, '`')}|\n|\S").search

    def fine(self, text: str) -> str:
        found = super().fine(text)
        return self._modes(text) if "X" in found and "`" in text and "${" in text else found

    def _modes(self, text: str) -> str:
        """The classes, where a template with code in it is a group of that code."""
        out: list[str] = []
        open_braces: list[int] = []
        at = 0
        while m := self.step(text, at):
            token, at = m[0], m.end()
            if token == "{" and open_braces:
                open_braces[-1] += 1
            elif token == "}" and open_braces:
                open_braces[-1] -= 1
            if token != "`" and not (token == "}" and open_braces and open_braces[-1] < 0):
                out.append(self.classes[token])
                continue
            chunk = _CHUNK.match(text, at)
            at = chunk.end()
            if chunk[1] is None:
                return "X"
            if token == "`":
                out.append("(" if chunk[1] == "${" else "P")
                if chunk[1] == "${":
                    open_braces.append(0)
            elif chunk[1] == "${":
                out.append(",")
                open_braces[-1] = 0
            else:
                out.append(")")
                open_braces.pop()
        return "X" if open_braces else "".join(out)


_SCRIPT = rf"//[^\n]*|{_BLOCK}|/\*|{_TEMPLATE}|[(,=:\[!&|?{{}};]\s*{_REGEX}|=>\s*{_REGEX}|\b(?:return|typeof|case|delete|void|throw|in|of|instanceof|await|yield)[ \t]*{_REGEX}|#?[^\W\d][\w$]*|#?\$[\w$]*|{_DQ}|{_SQ}|{_NUMBER}|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|&&|\|\||\?\?|\*\*|==|!=|<=|>=|<<|\A\#![^\n]*"
_JAVA = rf'//[^\n]*|{_BLOCK}|/\*|"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""|[^\W\d][\w$]*|\$[\w$]*|{_DQ}|\'(?:\\[^\n\']+|[^\'\\\n]|\\\')\'|{_NUMBER}|\.\.\.|::|->|<<=|\+\+|--|[-+*/%&|^]=|&&|\|\||==|!=|<=|>=|<<'
_GO = rf"//[^\n]*|{_BLOCK}|/\*|`[^`]*`|[^\W\d]\w*|{_DQ}|'(?:\\[^\n']+|[^'\\\n]|\\')'|{_NUMBER}|\.\.\.|:=|<<=|>>=|&\^=|&\^|<-|\+\+|--|[-+*/%&|^]=|&&|\|\||==|!=|<=|>=|<<|>>"
_PY_STRING = r"""(?:[rRbBuUfFtT]{0,2})(?:\"\"\"[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*')"""
_PYTHON = rf"#[^\n]*|{_PY_STRING}|[^\W\d]\w*|{_NUMBER}|\.\.\.|->|:=|\*\*=|//=|>>=|<<=|[-+*/%&|^@]=|\*\*|==|!=|<=|>=|<<|//|\\\r?\n"
_JSON = rf"{_DQ}|-?\d[\w.+-]*|\w+"


@cache
def lexer(language: str) -> Lexer:
    """The lexer of one of python, typescript, javascript, java, go, json."""
    if language == "python":
        return Lexer(_PYTHON, _PYTHON_WORDS, True, {"//": "o", "//=": "=", "!": "X", "?": "X", "$": "X", "#": ""})
    if language == "java":
        return Lexer(_JAVA, _JAVA_WORDS, False, {":=": "X", "=>": "X", "?.": "X", "`": "X", "#": "X", "/*": "X"})
    if language == "go":
        return Lexer(_GO, _GO_WORDS, True, {"?": "X", "=>": "X", "@": "X", "#": "X", "$": "X", "/*": "X", ">>": "o", "<-": "R"})
    if language == "json":
        return Lexer(_JSON, {}, False, {"true": "n", "false": "n", "null": "n", ";": "X"})
    words = _TYPED_WORDS if language == "typescript" else _SCRIPT_WORDS
    return Script(_SCRIPT, words, {"->": "X", ":=": "X", "#": "X", "\\": "X", "/*": "X"})
