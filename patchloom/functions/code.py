"""Statements of a snippet of code: one lexer and a skeleton parser for bracketed languages, ast for Python.

Small per-row helpers of the generators in operators.pairs and operators.features. They know
statements, blocks, calls and names, not whole grammars. What a statement's ancestors tell is
worked out by Spark.
"""

from __future__ import annotations

import ast
import re
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

# Words that open a statement, by the type that they make.
KEYWORDS = {
    "if": "if", "for": "for", "foreach": "for", "while": "while", "do": "do_while", "switch": "switch", "select": "switch", "try": "try_catch", "return": "return", "break": "break",
    "continue": "continue", "throw": "throw_raise", "goto": "goto", "defer": "defer", "go": "go_routine", "fallthrough": "fallthrough", "import": "import", "export": "export",
    "global": "global", "echo": "echo", "var": "assign", "let": "assign", "const": "assign",
}
# Which of them are words of each language.
WORDS = {
    "go": {"if", "for", "switch", "select", "return", "break", "continue", "goto", "defer", "go", "fallthrough", "var", "const"},
    "javascript": {"if", "for", "while", "do", "switch", "try", "return", "break", "continue", "throw", "import", "export", "var", "let", "const"},
    "php": {"if", "for", "foreach", "while", "do", "switch", "try", "return", "break", "continue", "throw", "goto", "global", "echo", "const"},
    "java": {"if", "for", "while", "do", "switch", "try", "return", "break", "continue", "throw"},
    "c": {"if", "for", "while", "do", "switch", "return", "break", "continue", "goto"},
    "rust": {"if", "for", "while", "return", "break", "continue", "let", "const"},
}
# Words that open what is no statement of the table.
LEAVES = {
    "go": {"type"}, "javascript": {"class", "abstract", "interface", "enum", "debugger", "declare", "namespace"},
    "php": {"class", "abstract", "final", "interface", "trait", "unset", "static", "use", "namespace", "declare", "exit"},
}
# Words that are no names of variables, and that a bracket may follow without being a call.
RESERVED = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while yield",
    "php": "abstract and array as break case catch class clone const continue declare default do echo else elseif empty extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface list match namespace new or print private protected public require require_once return static switch throw trait try use var while xor yield exit",
    "java": "assert break case catch class continue default do else finally for if new return switch synchronized throw try while",
    "c": "break case continue default do else for goto if return sizeof switch while",
    "rust": "as break const continue else fn for if impl in let loop match mut return struct while",
}
#: Java, Rust and C: what ends with a brace is a statement of its own if it begins with one of these, so that no semicolon follows.
BLOCKS = {"java": {"synchronized", "class", "interface", "enum", "record", "static"}, "c": set(), "rust": {"loop", "unsafe", "match", "if", "while", "for", "fn", "struct", "enum", "impl", "trait", "mod", "async", "union"}}
#: What goes on with a statement that ended with a brace.
TAILS = {"java": {"catch", "finally", "else"}, "c": {"else"}, "rust": {"else"}}
RESERVED = {language: frozenset(words.split()) for language, words in RESERVED.items()}
for table in (WORDS, LEAVES, RESERVED):
    table["typescript"] = table["javascript"]
#: Reserved, but a call all the same.
CALLED = {"javascript": {"super", "import"}, "typescript": {"super", "import"}, "php": {"empty"}}

_STRING = r"|(?P<string>%s`[^`]*`|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|(?P<name>%s)|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<space>\s+)"
_SIGNS = r"|(?P<sign>\?->|->|::|:=|<-|===|!==|=>|\*\*=?|==|!=|<=|>=|\+\+|--|&&=?|\|\|=?|\?\?=?|\.\.\.|<<=?|>>=?|\?\.|[-+*/%.&|^]=|.)"
_BLOCK = r"(?P<comment>//[^\n]*|/\*.*?\*/)"
_PYTHON = r"(?i:[rbuf]{1,2}(?=[\"']))?(?:\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|"
_LEXERS = {
    "python": re.compile(r"(?P<comment>#[^\n]*)" + _STRING % (_PYTHON, r"[^\W\d]\w*") + _SIGNS, re.S),
    # a one-line comment ends before ?>; after it comes a template's text, up to the next tag
    "php": re.compile(
        r"(?P<comment>#(?!\[)(?:(?!\?>)[^\n])*|//(?:(?!\?>)[^\n])*|/\*.*?\*/)|(?P<tag><\?(?:php\b|=)|\?>.*?(?:<\?(?:php\b|=)|\Z))|(?P<heredoc><<<[ \t]*(?P<quote>[\"']?)(?P<mark>\w+)(?P=quote)\n.*?^[ \t]*(?P=mark)\b)"
        + _STRING % ("", r"\$?\\?[A-Za-z_\x80-\U0010ffff][\w\\]*") + _SIGNS, re.S | re.M,
    ),
    "java": re.compile(_BLOCK + _STRING % ('\"\"\".*?\"\"\"|', r"[^\W\d]\w*|\$[\w$]*") + _SIGNS, re.S),
    # a quote that closes no character opens a lifetime's name
    "rust": re.compile(_BLOCK + r"|(?P<string>b?r(?P<hashes>#*)\".*?\"(?P=hashes)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:x\w\w|u\{\w+\}|.)|[^'\\\n])')|(?P<name>'?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<space>\s+)" + _SIGNS, re.S),
    "other": re.compile(_BLOCK + _STRING % ("", r"[^\W\d][\w]*|\$[\w$]*") + _SIGNS, re.S),
}
#: A literal regular expression of JavaScript: a slash opens one where no operand ends.
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/(?P<flags>[A-Za-z]*)")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof"}
OPEN, CLOSE = {"(", "[", "{", "${"}, {")", "]", "}"}
ASSIGNS = {"=", ":=", "+=", "-=", "*=", "/=", "%=", ".=", "&=", "|=", "^=", "**=", "??=", "||=", "&&=", "<<=", ">>="}
#: A line that ends so goes on; one that begins so, too.
GOES_ON = {",", ".", "->", "::", "+", "-", "*", "/", "%", "&&", "||", "(", "[", "{", "=>", "?", ":", "==", "&", "|", "<", ">", "===", "!=", "!==", "??", "?."} | ASSIGNS
GOES_BACK = {".", "?", ":", "&&", "||", "+", "?.", "??", "=>", "="}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    leaves: int  # tokens that a grammar makes of it


class Node:
    """A statement: its type, the block it stands in, its span, and child statements."""

    __slots__ = ("kind", "block", "start", "end", "children", "label", "defined", "test")

    def __init__(self, kind: str, block: str, start: int, end: int, children: list[Node] | None = None):
        self.kind, self.block, self.start, self.end, self.children, self.label = kind, block, start, end, children or [], 0
        self.defined: int | None = None  # names it assigns, if the parser knows
        self.test: tuple[int, int] | None = None  # span of an if's condition


def _pieces(body: str, language: str) -> int:
    """Tokens of a string's inside: escapes, and what stands between them (Python: that only if there are none)."""
    if not body:
        return 0
    escapes = len(re.findall(r"\\.", body, re.S))
    if language == "python":
        return escapes or 1
    return escapes + sum(1 for x in re.split(r"\\.", body, flags=re.S) if x)


_HOLES = {"js": re.compile(r"\$\{"), "php": re.compile(r"\{(?=\$)|\$[A-Za-z_]\w*"), "python": re.compile(r"\{\{|\}\}|\{")}


def _string(text: str, at: int, language: str) -> Iterator[Token]:
    """A string's tokens: one, or those of its parts and of the code in its holes."""
    quote = re.match(r"\w*('''|\"\"\"|.)", text, re.S).group()
    mark = quote.lstrip("rbufRBUF")
    holes = None
    if language in ("javascript", "typescript") and mark == "`" and "${" in text:
        holes = _HOLES["js"]
    elif language == "php" and mark == '"' and "$" in text:
        holes = _HOLES["php"]
    elif language == "python" and "f" in quote.lower() and "{" in text:
        holes = _HOLES["python"]
    end = len(text) - len(mark)
    if holes is None:
        yield Token("string", text, at, at + len(text), 2 + _pieces(text[len(quote) : end], language))
        return
    i, shown, first = len(quote), 0, quote
    while True:
        m = holes.search(text, i, end)
        while m and m.group() in ("{{", "}}"):
            m = holes.search(text, m.end(), end)
        stop = m.start() if m else end
        yield Token("string", first + text[i:stop] + ("" if m else mark), at + shown, at + (stop if m else len(text)), bool(first) + _pieces(text[i:stop], language) + (m is None))
        if not m:
            return
        first = ""
        if m.group()[0] == "$" and m.group() != "${":
            yield Token("name", m.group(), at + stop, at + m.end(), 2)
            i = shown = m.end()
            continue
        depth, j = 1, m.end()
        while j < end and depth:
            depth += (text[j] == "{") - (text[j] == "}")
            j += 1
        yield Token("hole", m.group(), at + stop, at + m.end(), 1)
        inner = re.sub(r"(?:![rsa])?(?::[^\[\]()'\"]*)?$", "", text[m.end() : j - 1]) if language == "python" else text[m.end() : j - 1]
        yield from (t._replace(start=t.start + at + m.end(), end=t.end + at + m.end()) for t in lex(inner, language) if t.kind != "line")
        yield Token("sign", "}", at + j - 1, at + j, 1)
        i = shown = j


def _heredoc(m: re.Match) -> Iterator[Token]:
    """A heredoc's tokens: its marks and text, and the variables in it; one whose mark is in single quotes has none."""
    text, at = m.group(), m.start()
    first, last = text.index("\n") + 1, text.rindex("\n")
    quoted, shown = m["quote"] == "'", 0
    for hole in [] if quoted else re.finditer(r"\$[A-Za-z_]\w*", text[first:last]):
        yield Token("string", text[shown : first + hole.start()], at + shown, at + first + hole.start(), (0 if shown else 2) + (hole.start() > (shown and shown - first)))
        shown = first + hole.end()
        yield Token("name", hole.group(), at + first + hole.start(), at + shown, 2)
    yield Token("string", text[shown:], at + shown, m.end(), (1 if shown else 3 + 2 * quoted) + (last > max(shown, first)))


def _scripted(code: str, language: str) -> Iterator[tuple[str, re.Match]]:
    """(kind, match) of JavaScript's tokens; whether a slash divides is told by what stands before it."""
    pattern, at, last, of, opened, condition = _LEXERS["other"], 0, None, "", [], False
    while m := pattern.match(code, at):
        kind, text = m.lastgroup, m.group()
        if kind == "sign" and text in ("/", "/="):
            operand = of in ("number", "string", "regex")
            if of == "sign":
                # a bracket ends an operand, but not that of an if or a loop; a brace ends one where its line goes on
                operand = last.group() in ("]", "++", "--") or last.group() == ")" and not condition or last.group() == "}" and "\n" not in code[last.end() : at]
            elif of == "name":
                operand = last.group() not in _BEFORE_REGEX
            if not operand and (found := _REGEX.match(code, at)):
                kind, m = "regex", found
        if kind not in ("line", "space", "comment"):
            if text == "(" and kind == "sign":
                opened.append(last is not None and last.group() in ("if", "while", "for", "with"))
            elif text == ")" and kind == "sign":
                condition = opened.pop() if opened else False
            last, of = m, kind
        yield kind, m
        at = m.end()


def lex(code: str, language: str) -> list[Token]:
    """Tokens without white space; line ends and comments are kept."""
    out: list[Token] = []
    if language in ("javascript", "typescript"):
        found = _scripted(code, language)
    else:
        start = max(0, min((i for i in (code.find("<?php"), code.find("<?=")) if i >= 0), default=0)) if language == "php" else 0
        found = ((m.lastgroup, m) for m in _LEXERS.get(language, _LEXERS["other"]).finditer(code, start))
    for kind, m in found:
        text = m.group()
        if kind == "string":
            out.extend(_string(text, m.start(), language))
        elif kind == "heredoc":
            out.extend(_heredoc(m))
        elif kind == "regex":
            out.append(Token("regex", text, m.start(), m.end(), 3 + bool(m["flags"])))
        elif kind == "tag":
            if text.startswith("?>") and out:  # ends a statement, as a semicolon does that takes no room
                out.append(Token("sign", ";", out[-1].end, out[-1].end, 0))
        elif kind != "space":
            out.append(Token(kind, text, m.start(), m.end(), 0 if kind == "line" else 2 if kind == "name" and text[0] == "$" and language == "php" else 1))
    return out


def brackets(tokens: list[Token]) -> dict[int, int]:
    """Of each bracket, opening or closing, the index of the other."""
    pairs, stack = {}, []
    for i, t in enumerate(tokens):
        if t.text in OPEN and t.kind != "string":
            stack.append(i)
        elif t.text in CLOSE and t.kind == "sign" and stack:
            j = stack.pop()
            pairs[i], pairs[j] = j, i
    return pairs


class Skeleton:
    """Statements of a bracketed language."""

    def __init__(self, tokens: list[Token], language: str):
        self.language, self.tokens, self.at = language, [t for t in tokens if t.kind != "comment"], 0
        self.words, self.leaves = WORDS[language], LEAVES.get(language, set())

    def text(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].text if i < len(self.tokens) else ""

    def skip(self, *what: str) -> None:
        while self.text() in what:
            self.at += 1

    def past(self) -> int:
        """Go past one token, or past a whole bracket; where it ended."""
        depth, end = 0, 0
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            self.at += 1
            depth += (t.text in OPEN and t.kind != "string") - (t.text in CLOSE and t.kind == "sign")
            end = t.end
            if depth <= 0:
                break
        return end

    def header(self, node: Node) -> None:
        """Go to the brace that opens a body (or, for a body without one, past the bracketed condition); statements in it are children."""
        if self.text() == "(" and self.language != "go":
            if self.language in ("javascript", "typescript") and node.kind == "for" and self.text(1) in ("let", "const", "var"):
                first, mark = self.tokens[self.at + 1], self.at
                self.at += 1
                while self.at < len(self.tokens) and self.text() not in (";", ")", "of", "in"):
                    end = self.past()
                if self.text() == ";":
                    node.children.append(Node("assign", node.block, first.start, self.tokens[self.at].end))
                self.at = mark
            self.past()
            self.skip("\n")
            return
        first, start, inits = self.at, self.at, []
        while self.at < len(self.tokens) and self.text() != "{":
            if self.text() == ";":
                inits.append((start, self.at))
                start = self.at + 1
            self.past()
            while self.language == "go" and self.text() == "{" and self.at > first and self.literal(first):
                self.past()
        if node.kind in ("if", "switch") and inits and inits[0][0] < inits[0][1]:
            own = self.tokens[inits[0][0] : inits[0][1]]
            node.children.append(Node(self.kind("", own), node.block, own[0].start, own[-1].end))
        if node.kind == "if" and start < self.at:
            node.test = (self.tokens[start].start, self.tokens[self.at - 1].end)

    def colon(self, *ends: str) -> bool:
        """Go past PHP's body between a colon and one of these words, which stays; whether there is one."""
        self.skip("\n")
        if self.language != "php" or self.text() != ":":
            return False
        self.at += 1
        depth = 0
        while self.at < len(self.tokens):
            word = self.text().lower()
            if depth == 0 and word in ends:
                break
            depth += self.opens(word) - (word in ("endif", "endfor", "endforeach", "endwhile", "endswitch"))
            self.past()
        return True

    def opens(self, word: str) -> bool:
        """Whether this word opens a body between a colon and its end."""
        if word not in ("if", "for", "foreach", "while", "switch") or self.text(1) != "(":
            return False
        mark = self.at
        self.at += 1
        self.past()
        self.skip("\n")
        found, self.at = self.text() == ":", mark
        return found

    def ended(self, word: str) -> None:
        """Go past the word that ends such a body, and its semicolon."""
        if self.text().lower() == word:
            self.at += 1
            self.at += self.text() == ";"

    def literal(self, first: int) -> bool:
        """Whether the brace ahead, in a header of Go that begins at `first`, belongs to a type or to a literal of a slice, array or map."""
        i = self.at - 1
        if self.tokens[i].text in ("=", ":=", "range", "struct", "interface"):
            return True
        if self.tokens[i].text == "}":  # of a struct's type
            depth = 0
            while i > first:
                depth += (self.tokens[i].text == "}") - (self.tokens[i].text == "{")
                if depth == 0:
                    return self.tokens[i - 1].text in ("struct", "interface")
                i -= 1
            return False
        while i - 2 > first and self.tokens[i].kind == "name" and self.tokens[i - 1].text == ".":
            i -= 2
        return self.tokens[i].kind == "name" and i > first and self.tokens[i - 1].text == "]"

    def body(self, block: str) -> list[Node]:
        """The statements of a braced body, or the one statement that stands for it."""
        self.skip("\n")
        if self.text() == "{":
            self.at += 1
            found = self.statements(block)
            self.at += 1
            return found
        return self.statement(block)

    def statements(self, block: str) -> list[Node]:
        found: list[Node] = []
        while True:
            self.skip("\n", ";")
            if self.at >= len(self.tokens) or self.text() == "}":
                return found
            before = self.at
            found += self.statement(block)
            if self.at == before:
                self.at += 1

    def last_end(self) -> int:
        i = self.at - 1
        while i >= 0 and self.tokens[i].kind == "line":
            i -= 1
        return self.tokens[i].end if i >= 0 else 0

    def statement(self, block: str) -> list[Node]:
        self.skip("\n", ";")
        if self.at >= len(self.tokens) or self.text() == "}":
            return []
        first = self.tokens[self.at]
        word = first.text.lower() if self.language == "php" else first.text
        after = self.text(1)
        if self.language in BLOCKS and (own := self.braced(block, word)) is not None:
            return [own]
        if word == "{":
            return self.body(block)
        if word in ("case", "default") and (block == "switch_case" or after == ":"):
            while self.at < len(self.tokens) and self.text() not in (":", "}"):
                self.past()
            self.at += self.text() == ":"
            return []
        scripted = self.language in ("javascript", "typescript")
        if first.kind == "name" and after == ":" and (self.language == "go" or scripted) and word not in self.words:
            node = Node("label", block, first.start, first.end)
            self.at += 2
            node.children = self.statement(block)
        elif word == "export":
            node = Node("export", block, first.start, first.end)
            self.at += 1 + (after == "default")
            node.children = self.statement(block) if self.text() not in ("{", "*") else []
            while not node.children and self.at < len(self.tokens) and self.text() not in (";", "\n"):
                self.past()
            self.at += self.text() == ";"
        elif word in self.words and KEYWORDS[word] in ("if", "for", "while", "do_while", "switch", "try_catch"):
            node = Node(KEYWORDS[word], block, first.start, first.end)
            self.at += 1 + (after == "await")
            getattr(self, f"_{node.kind}")(node)
        elif self.is_function():
            node = Node("function_def", block, first.start, first.end)
            starred = any(self.text(i) == "*" for i in range(3))
            while self.at < len(self.tokens) and self.text() != "{":
                typed = self.language == "typescript" and self.text() in (":", "|", "&") and self.text(1) == "{"
                self.at += typed
                self.past()
            node.children = self.body("function_body")
            if starred:
                return []
        elif self.language == "typescript" and word == "type" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].kind == "name":
            self.simple(block, word)
            return []
        elif word in self.leaves and not (word == "static" and after == "::") and not (scripted and after in ("=", ".", "(")):
            while self.at < len(self.tokens) and self.text() not in (";", "}"):
                brace = self.text() == "{"
                self.past()
                if brace or self.text() == "\n" and self.language != "php" and word not in ("class", "interface"):
                    break
            return []
        else:
            return [self.simple(block, word)]
        node.end = self.last_end()
        return [node]

    def braced(self, block: str, word: str) -> Node | None:
        """A statement of Java, C or Rust that a brace ends, with what belongs to it, or a directive of C's preprocessor."""
        first, tails = self.tokens[self.at], TAILS[self.language]
        if self.language == "c" and word == "#" and (self.at == 0 or self.tokens[self.at - 1].kind == "line" or first.start == 0):
            self.directive()
            return Node("expr_stmt", block, first.start, self.last_end())
        if self.language == "rust" and first.text[0] == "'" and self.text(1) == ":":
            self.at += 2
            word = self.text()
        if self.language == "rust" and word == "#" and self.text(1) == "[":  # an attribute
            self.at += 1
            self.past()
            return Node("expr_stmt", block, first.start, self.last_end())
        if word != "{" and word not in BLOCKS[self.language] or word == "static" and self.text(1) != "{":
            return None
        mark = self.at
        while True:
            while self.at < len(self.tokens) and self.text() not in ("{", ";", "}"):
                self.past()
            if self.text() != "{":  # no body after all
                self.at = mark
                return None
            self.past()
            end = self.at
            self.skip("\n")
            if self.text() not in tails:
                break
        if self.language == "rust" and self.text() in (".", "?"):  # a value that the expression goes on with
            self.at = mark
            return None
        self.at = end
        return Node("expr_stmt", block, first.start, self.last_end())

    def directive(self) -> None:
        """Go past a line of the preprocessor, and what it goes on with; past all up to its end, if it opens a condition."""
        depth = 0
        while self.at < len(self.tokens):
            if self.text() == "#":
                word = self.text(1)
                depth += word in ("if", "ifdef", "ifndef")
                depth -= word == "endif"
            while self.at < len(self.tokens) and self.text() != "\n":
                self.at += 1 + (self.text() == "\\" and self.text(1) == "\n")
            if depth <= 0:
                return
            self.skip("\n")
            while self.at < len(self.tokens) and self.text() != "#":
                while self.at < len(self.tokens) and self.text() != "\n":
                    self.at += 1
                self.skip("\n")

    def is_function(self) -> bool:
        i = 1 if self.text() in ("async", "static") else 0
        name = i + 1 + (self.text(i + 1) in ("*", "&"))
        return self.text(i) in ("function", "func", "fn") and self.at + name < len(self.tokens) and self.tokens[self.at + name].kind == "name"

    def _if(self, node: Node) -> None:
        self.header(node)
        ends = ("elseif", "else", "endif")
        # statements between colons have no rows
        colons = self.colon(*ends)
        if not colons:
            node.children += self.body("if_true_branch")
        while True:
            mark = self.at
            self.skip("\n")
            word = self.text().lower() if self.language == "php" else self.text()
            if word == "elseif":
                # a clause of the same if: the further ones, and else, aren't its own
                inner = Node("if", "if_false_branch", self.tokens[self.at].start, 0)
                self.at += 1
                self.header(inner)
                if not self.colon(*ends):
                    inner.children += self.body("if_true_branch")
                inner.end = self.last_end()
                node.children.append(inner)
                continue
            if word == "else" and colons:
                self.at += 1
                self.colon("endif")
                continue
            if word == "endif" and colons:
                self.ended("endif")
                return
            if word == "else":
                self.at += 1
                self.skip("\n")
                node.children += self.statement("if_false_branch") if self.text() == "if" else self.body("if_false_branch")
            else:
                self.at = mark
            return

    def _for(self, node: Node) -> None:
        word = self.tokens[self.at - 1].text.lower()
        self.header(node)
        self.skip("\n")
        if word == "for" and self.language == "php" and self.text() == ":":
            # here alone the statements stand in the loop itself
            self.at += 1
            while self.at < len(self.tokens) and self.text().lower() != "endfor":
                before = self.at
                self.skip("\n", ";")
                if self.text().lower() != "endfor":
                    node.children += self.statement("loop_body")
                    self.at += self.at == before
            self.ended("endfor")
        elif self.colon(f"end{word}"):
            self.ended(f"end{word}")
        else:
            node.children += self.body("loop_body")

    _while = _for

    def _do_while(self, node: Node) -> None:
        node.children = self.body("loop_body")
        self.skip("\n")
        if self.text() == "while":
            self.at += 1
            self.past()
            self.at += self.text() == ";"

    def _switch(self, node: Node) -> None:
        self.header(node)
        self.skip("\n")
        if self.language == "php" and self.text() == ":":
            self.at += 1
            while self.at < len(self.tokens) and self.text().lower() != "endswitch":
                before = self.at
                self.skip("\n", ";")
                if self.text().lower() != "endswitch":
                    node.children += self.statement("switch_case")
                    self.at += self.at == before
            self.ended("endswitch")
        else:
            node.children += self.body("switch_case")

    def _try_catch(self, node: Node) -> None:
        if self.text() == "(":  # resources
            self.past()
        node.children = self.body("try_body")
        while True:
            mark = self.at
            self.skip("\n")
            block = {"catch": "exception_handler", "finally": "finally_block"}.get(self.text())
            if block is None:
                self.at = mark
                return
            self.at += 1
            if self.text() == "(":
                self.past()
            node.children += self.body(block)

    def simple(self, block: str, word: str) -> Node:
        """A statement up to its semicolon, or the end of a line that doesn't go on."""
        first, own, ended = self.tokens[self.at], self.at, 0
        lined = self.language in ("go", "javascript", "typescript")
        while self.at < len(self.tokens):
            t = self.tokens[self.at]
            if t.text in (";", "}") and t.kind == "sign":
                break
            if t.kind == "line":
                last = self.tokens[self.at - 1].text if self.at > own else ""
                ahead = next((x.text for x in self.tokens[self.at :] if x.kind != "line"), "")
                if lined and last not in GOES_ON and (ahead not in GOES_BACK or self.language == "go"):
                    break
                self.at += 1
                continue
            ended = self.past()
        tokens = [t for t in self.tokens[own : self.at] if t.kind != "line"]
        semicolon = self.text() == ";" and self.language != "go"
        end = self.tokens[self.at].end if semicolon else ended
        self.at += semicolon
        return Node(self.kind(word, tokens), block, first.start, end)

    def kind(self, word: str, own: list[Token]) -> str:
        if word in self.words:
            return KEYWORDS[word]
        depth, signs = 0, []
        for t in own:
            depth += (t.text in OPEN and t.kind != "string") - (t.text in CLOSE and t.kind == "sign")
            if depth == 0 and t.kind == "sign":
                signs.append(t.text)
        go = self.language == "go"
        if any(x == "=" or go and (x in ASSIGNS or x in ("++", "--")) for x in signs):
            return "expr_stmt" if "=>" in signs and "=" not in signs[: signs.index("=>")] else "assign"
        if go:
            return "send" if "<-" in signs and own[0].text != "<-" else "call_expr"
        if any(x in ASSIGNS or x in ("++", "--") for x in signs):
            return "expr_stmt"
        whole = any(a == own[0].start and b == own[-1].end and not made for a, b, _, made in calls(own, self.language, "".join)) if own and own[-1].text in (")", "`") else False
        return "call_expr" if whole else "expr_stmt"


def _angle(tokens: list[Token], i: int) -> int | None:
    """The token that opens the list of types that ends at i, after a name; None where there is no such list."""
    if i < 2 or tokens[i].text not in (">", ">>"):
        return None
    depth = 0
    while i > 0:
        t = tokens[i]
        if t.text in (">", ">>"):
            depth += len(t.text)
        elif t.text == "<":
            depth -= 1
            if depth <= 0:
                return i if depth == 0 and tokens[i - 1].kind == "name" else None
        elif t.text in (";", "(", ")", "&&", "||", "+", "-", "*", "/", "=="):
            return None
        i -= 1
    return None


def calls(own: list[Token], language: str, text_of) -> list[tuple[int, int, str, bool]]:
    """(start, end, name, made by new) of each call among a statement's tokens; the name is the called expression's text, by text_of (start, end) or the tokens joined."""
    pairs, reserved, called = brackets(own), RESERVED[language], CALLED.get(language, ())
    joined = text_of == "".join
    scripted = language in ("javascript", "typescript")

    def name_of(lo: int, hi: int) -> str:
        return "" if joined else text_of(own[lo].start, own[hi].end)

    def before(j: int) -> int | None:
        """The first token of the postfix chain that ends at j."""
        while True:
            t = own[j]
            if t.text in (")", "]", "}") and t.kind == "sign":
                if j not in pairs:
                    return None
                j = pairs[j]
                if t.text == "}":  # a function's body: back to its keyword
                    while j >= 0 and own[j].text not in ("func", "function", "=>"):
                        j = pairs[j] - 1 if own[j].text in (")", "]") and j in pairs else j - 1
                    return max(j, 0)
                if j and (own[j - 1].text in (")", "]") or own[j - 1].kind in ("name", "string") and own[j - 1].text not in reserved):
                    j -= 1
                    continue
                return j
            if j >= 2 and own[j - 1].text in (".", "->", "::", "?.", "?->"):
                j -= 2
                continue
            return j

    found = []
    for i, t in enumerate(own):
        if t.text == "new" and scripted and t.kind == "name":
            j = i + 1
            while j + 2 < len(own) and own[j + 1].text == ".":
                j += 2
            if j < len(own):
                opened = j + 1 < len(own) and own[j + 1].text == "("
                found.append((t.start, own[pairs.get(j + 1, j + 1)].end if opened else own[j].end, name_of(i + 1, j), True))
            continue
        if t.text != "(" or i == 0 or t.kind == "string":
            continue
        opening = i
        typed = _angle(own, i - 1) if language == "typescript" else None
        if typed:
            i = typed  # as if the call had no types
        last = own[i - 1]
        if not (last.kind in ("name", "string") and (last.text not in reserved or last.text in called or i > 1 and own[i - 2].text in (".", "->", "?.", "::")) or last.text in (")", "]", "}") and last.kind == "sign"):
            continue
        j = before(i - 1)
        if j is None or own[j].text in reserved and own[j].text not in called and own[j].text not in ("this", "func", "function", "static", "new"):
            continue
        if last.text == "}" and own[j].text not in ("func", "function"):
            continue
        ahead = own[j - 1].text if j else ""
        if ahead in ("function", "func", "fn", "def") or ahead == "new" and (language == "php" or before(i - 1) == j and not any(own[k].text in (")", "]") for k in range(j, i))):
            continue
        if language == "go" and (ahead == "]" and own[j - 2].text == "[" or own[j].text == "[" and j + 1 in (pairs.get(j), i)):
            continue
        close = pairs.get(opening, len(own) - 1)
        if scripted and close + 1 < len(own) and own[close + 1].text == "{" and last.kind == "name" and not ahead:
            continue
        if language == "php" and i > 1 and own[i - 2].text == "?->":
            continue
        j -= ahead == "new"
        found.append((own[j].start, own[close].end, name_of(j, i - 1), False))
    return found


#: Calls within calls at most; code that nests deeper can't be worked on.
DEEPEST = 50_000


class Side:
    """One version of a method: its tokens, read once, and its statements."""

    def __init__(self, code: str, language: str, parse: Callable[[str], list[Node]] | None = None):
        self.code, self.language = code, language
        every = lex(code, language)
        self.tokens = [t for t in every if t.kind not in ("line", "comment")]
        self.starts = [t.start for t in self.tokens]
        counted = [t for t in every if t.leaves]
        self.counted, self.leaves = [t.start for t in counted], [0]
        for t in counted:
            self.leaves.append(self.leaves[-1] + t.leaves)
        self.lines = [m.start() for m in re.finditer("\n", code)]
        # as deep as braces and bodies without them can nest
        deep = 1000 + 8 * sum(t.text in ("{", "if", "for", "while", "else", "do") for t in self.tokens)
        if deep > sys.getrecursionlimit():
            sys.setrecursionlimit(min(deep, DEEPEST))
        self.roots = parse(code) if parse else python_nodes(code) if language == "python" else _first_body(every, self.tokens, language)

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def n_tokens(self, node: Node) -> int:
        return self.leaves[bisect_left(self.counted, node.end)] - self.leaves[bisect_left(self.counted, node.start)]

    def own(self, node: Node) -> list[Token]:
        """The node's tokens without its children's."""
        out, at = [], node.start
        for lo, hi in [*sorted((c.start, c.end) for c in node.children), (node.end, node.end)]:
            if lo > at:
                out += self.tokens[bisect_left(self.starts, at) : bisect_left(self.starts, lo)]
            at = max(at, hi)
        return out

    def own_text(self, node: Node) -> str:
        """The node's text without its children's: its header, for compound statements."""
        out, at = [], node.start
        for child in sorted(node.children, key=lambda n: n.start):
            out.append(self.code[at : child.start])
            at = max(at, child.end)
        return "".join([*out, self.code[at : node.end]])


def joins(own: list[Token], language: str) -> bool:
    """Whether text is joined or filled in: by an operator between two operands, or by a string with holes (PHP: in double quotes, JavaScript: in backticks)."""
    if language == "python":
        return any(t.kind == "hole" for t in own)
    sign, quote = ("." if language == "php" else "+"), {"php": '"', "go": None}.get(language, "`")
    reserved = RESERVED[language]

    def operand(t: Token) -> bool:
        return t.kind in ("number", "string") or t.kind == "name" and (t.text not in reserved or t.text in ("this", "null", "nil", "true", "false", "undefined")) or t.text in (")", "]", "}") and t.kind == "sign"

    return any(t.kind == "string" and t.text[0] == quote or t.text == sign and t.kind == "sign" and i and operand(own[i - 1]) for i, t in enumerate(own))


def _parts(own: list[Token]) -> list[list[Token]]:
    """Tokens between commas outside brackets."""
    out, depth = [[]], 0
    for t in own:
        depth += (t.text in OPEN and t.kind != "string") - (t.text in CLOSE and t.kind == "sign")
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def n_defined(kind: str, own: list[Token], language: str) -> int:
    """Names that an assignment's own tokens give a value."""
    if kind != "assign" or not own:
        return 0
    scripted, word = language in ("javascript", "typescript"), own[0].text
    if word in ("var", "let", "const") and (scripted or language == "go"):
        if language == "go":
            return int(word == "var" and len(own) > 1 and own[1].kind == "name")
        return sum(1 for part in _parts(own[1:]) if part and part[0].kind == "name")
    at = next((i for i, t in enumerate(own) if t.text in ASSIGNS and t.kind == "sign"), None)
    if at is None or word == "const":
        return 0
    left = own[:at]
    if language == "go":
        return sum(1 for part in _parts(left) if len(part) == 1 and part[0].kind == "name")
    if scripted:
        return int(len(left) == 1 and left[0].kind == "name")
    if len(left) == 1 or len(left) == 3 and left[1].text in ("->", "::"):
        return sum(1 for t in (left[0], left[-1]) if t.text[0] == "$") if len(left) == 3 else int(left[0].text[0] == "$")
    if left[0].text in ("[", "list"):
        return sum(1 for part in _parts(left[1 + (left[0].text == "list") : -1]) if len(part) == 1 and part[0].text[0] == "$")
    if left[0].text[0] == "$" and left[1].text == "[" and brackets(left).get(1) == len(left) - 1:
        return 1 + (len(left) == 4 and left[2].text[0] == "$")
    return 0


# TypeScript's own types, which are no names.
TYPES = {"string", "number", "boolean", "any", "void", "unknown", "never", "object", "symbol", "bigint"}


def n_names(own: list[Token], language: str) -> int:
    """Names of variables, functions and packages among a statement's tokens; fields count in Python alone."""
    reserved = RESERVED[language]
    if language == "php":
        return sum(1 for t in own if t.kind == "name" and t.text[0] == "$")
    names = [i for i, t in enumerate(own) if t.kind == "name" and t.text not in reserved]
    if language == "python":
        return len(names)

    def near(i: int) -> str:
        return own[i].text if 0 <= i < len(own) else ""

    if language == "go":
        # types: after a name, a closing square bracket or a star that no operand precedes; of a literal, before its brace
        typed = {i for i in names if near(i - 1) in (".", "]") or i and own[i - 1].kind == "name" and near(i - 1) not in reserved or near(i - 1) in ("new", "chan", "map") or near(i + 1) == "{" and near(i - 1) in (":=", "=", ",", "(", "&", "return", "[", ":", "*")}
        return len(names) - len(typed)
    inside, stack = {}, []
    for i, t in enumerate(own):
        if t.text in CLOSE and t.kind == "sign" and stack:
            stack.pop()
        inside[i] = stack[-1] if stack else ""
        if t.text in OPEN and t.kind != "string":
            stack.append(t.text)

    def field(i: int) -> bool:
        if near(i - 1) in (".", "?.") or language == "typescript" and own[i].text in TYPES:
            return True
        return inside[i] == "{" and near(i - 1) in ("{", ",") and near(i + 1) in (",", "}", ":", "(")

    return sum(1 for i in names if not field(i))


# Statement types of Python's syntax tree.
PYTHON_KINDS = {
    "Assign": "assign", "AugAssign": "assign", "AnnAssign": "assign", "If": "if", "For": "for", "AsyncFor": "for", "While": "while", "Try": "try_catch", "TryStar": "try_catch",
    "With": "with", "AsyncWith": "with", "Raise": "throw_raise", "Return": "return", "Break": "break", "Continue": "continue", "FunctionDef": "function_def", "AsyncFunctionDef": "function_def",
    "Import": "import", "ImportFrom": "import", "Pass": "pass", "Global": "global", "Nonlocal": "nonlocal", "Assert": "assert", "Delete": "delete",
}


def _target(x: ast.expr) -> int:
    """Names directly in what a Python assignment assigns to."""
    if isinstance(x, ast.Name):
        return 1
    if isinstance(x, ast.Tuple | ast.List):
        return sum(isinstance(e, ast.Name) for e in x.elts)
    if isinstance(x, ast.Attribute):
        return 1 + isinstance(x.value, ast.Name)
    if isinstance(x, ast.Subscript):
        return isinstance(x.value, ast.Name) + sum(isinstance(e, ast.Name) for e in (x.slice.elts if isinstance(x.slice, ast.Tuple) else [x.slice]))
    return 0


#: Headers that keep a block together where its own can't be read, by their first word.
HEADERS = {
    "if": "if 1:", "elif": "elif 1:", "else": "else:", "for": "for _ in _:", "while": "while 1:", "try": "try:", "except": "except:", "finally": "finally:", "with": "with _:", "def": "def _():", "class": "class _:",
}
#: Lines that are given up at most, in code with errors.
ERRORS = 100


def _python_tree(code: str) -> tuple[ast.Module, int, frozenset[int]] | None:
    """The tree of a snippet, which may be indented, how many lines stand before it, and the lines (from 0) that were left out as errors."""
    for before in ("", "if 1:\n"):
        try:
            return ast.parse(before + code), before.count("\n"), frozenset()
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    lines, lost = code.split("\n"), set()
    before = "if 1:\n" if next((x for x in lines if x.strip()), "")[:1].isspace() else ""
    skipped = before.count("\n")
    for _ in range(ERRORS):
        try:
            return ast.parse(before + "\n".join(lines)), skipped, frozenset(lost)
        except SyntaxError as e:
            at = min((e.lineno or 1) - 1 - skipped, len(lines) - 1)
            while at >= 0 and (at in lost or not lines[at].strip()):
                at -= 1  # the line before is what lacks its end
            if at < 0:
                return None
            text = lines[at].strip()
            lines[at] = lines[at][: len(lines[at]) - len(lines[at].lstrip())] + HEADERS.get(re.match(r"\w*", text).group(), "pass")
            lost.add(at)
        except (ValueError, RecursionError, MemoryError):
            return None
    return None


def python_nodes(code: str) -> list[Node]:
    """Statements of the first function of Python code, or of all of it, by Python's own parser; lines, if it can't read the snippet."""
    parsed = _python_tree(code)
    if parsed is None:
        return [Node(_line_kind(m.group(1)), "function_body", m.start(1), m.end(1)) for m in re.finditer(r"^[ \t]*([^\s#].*?)[ \t]*$", code, re.M)]
    tree, skipped, lost = parsed
    lines, starts = code.splitlines(keepends=True), [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def place(line: int, col: int, ends: bool = False) -> int:
        line -= skipped + 1
        if ends and line in lost:
            return starts[line] + len(lines[line].rstrip())
        if line >= len(lines):
            return len(code)
        text = lines[line]
        return starts[line] + (col if text.isascii() else len(text.encode()[:col].decode(errors="ignore")))

    def walk(body: list[ast.stmt], block: str) -> list[Node]:
        found = []
        for s in body:
            name = type(s).__name__
            if name == "Pass" and s.lineno - skipped - 1 in lost:
                continue
            kind = PYTHON_KINDS.get(name)
            if name == "Expr":
                bare = isinstance(s.value, ast.Tuple) and s.value.col_offset == s.value.elts[0].col_offset if isinstance(s.value, ast.Tuple) and s.value.elts else False
                kind = "call_expr" if isinstance(s.value, ast.Call) else "expression_statement" if bare else "expr_stmt"
            if kind is None or kind == "function_def" and s.decorator_list:
                continue  # classes, matches and decorated functions have no rows
            node = Node(kind, block, place(s.lineno, s.col_offset), place(s.end_lineno, s.end_col_offset, True))
            if kind == "assign":
                node.defined = _target(s.targets[0] if name == "Assign" else s.target)
            elif kind == "if":
                node.children = walk(s.body, "if_true_branch")
                rest = s.orelse
                while len(rest) == 1 and isinstance(rest[0], ast.If) and code.startswith("elif", place(rest[0].lineno, rest[0].col_offset)):
                    # a clause of the same if: the further ones, and else, aren't its own
                    clause = rest[0]
                    inner = Node("if", "if_false_branch", place(clause.lineno, clause.col_offset), place(clause.body[-1].end_lineno, clause.body[-1].end_col_offset, True))
                    inner.children = walk(clause.body, "if_true_branch")
                    node.children.append(inner)
                    rest = clause.orelse
                node.children += walk(rest, "if_false_branch")
            elif kind in ("for", "while"):
                node.children = walk(s.body, "loop_body") + walk(s.orelse, "loop_else_branch")
            elif kind == "try_catch":
                node.children = walk(s.body, "try_body") + [c for h in s.handlers for c in walk(h.body, "exception_handler")]
                node.children += walk(s.orelse, "try_else_branch") + walk(s.finalbody, "finally_block")
            elif kind == "function_def":
                node.children = walk(s.body, "function_body")
            elif kind == "with":
                node.children = walk(s.body, "with_body")
            found.append(node)
        return found

    body = tree.body[0].body if skipped else tree.body
    todo = list(body)
    while todo:
        s = todo.pop(0)
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
            return walk(s.body, "function_body")
        todo = [x for x in ast.iter_child_nodes(s) if isinstance(x, ast.stmt | ast.ExceptHandler)] + todo
    return walk(body, "function_body")


def _line_kind(line: str) -> str:
    """The type of a line of Python that its parser can't read."""
    word = re.match(r"\w*", line).group()
    known = {"if": "if", "elif": "if", "for": "for", "while": "while", "try": "try_catch", "with": "with", "return": "return", "raise": "throw_raise", "import": "import", "from": "import"}
    plain = {w: w for w in ("break", "continue", "pass", "global", "nonlocal", "assert")} | {"del": "delete", "def": "function_def"}
    if kind := (known | plain).get(word):
        return kind
    return "assign" if re.search(r"(?<![=!<>])=(?!=)", re.sub(r"\(.*\)", "()", line)) else "call_expr" if re.fullmatch(r"[\w.]+\(.*\)", line) else "expr_stmt"


def _first_body(every: list[Token], tokens: list[Token], language: str) -> list[Node]:
    """The statements of the first function, or of all the code if it has none."""
    found = functions(tokens, language)
    first = min(found, default=None)
    if language in ("javascript", "typescript"):
        arrow = next((i for i, t in enumerate(tokens) if t.text == "=>" and i + 1 < len(tokens) and tokens[i + 1].text != "{"), None)
        if arrow is not None and (first is None or arrow < first[0]):
            return []  # the first function's body is an expression
    if first is not None:
        start, end = tokens[first[1]].end, tokens[first[2]].start
        every = [t for t in every if start <= t.start < end]
    return Skeleton(every, language).statements("function_body")


def functions(tokens: list[Token], language: str) -> list[tuple[int, int, int]]:
    """(first token, opening brace, closing brace) of the function-like constructs of a bracketed language."""
    pairs, out = brackets(tokens), []
    for i, t in enumerate(tokens):
        if t.text == "{" and t.kind == "sign" and i in pairs:
            head = _head(tokens, i, language, pairs)
            if head is not None:
                out.append((head, i, pairs[i]))
    return out


def method_spans(code: str, language: str) -> list[tuple[int, int]]:
    """Spans of the function-like constructs, outermost only (Java: nested ones as well)."""
    if language == "python":
        parsed = _python_tree(code)
        if parsed is None:
            return []
        (tree, skipped, _), lines = parsed, [0]
        for line in code.splitlines(keepends=True):
            lines.append(lines[-1] + len(line))
        top, stack = [], list(tree.body[0].body if skipped else tree.body)
        while stack:
            n = stack.pop(0)
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                last = n.end_lineno - skipped
                top.append((lines[n.lineno - skipped - 1], lines[last] if last < len(lines) else len(code)))
            else:
                stack = list(ast.iter_child_nodes(n)) + stack
        return top
    tokens = [t for t in lex(code, language) if t.kind not in ("line", "comment")]
    found = [(tokens[head].start, tokens[close].end) for head, _, close in functions(tokens, language)]
    if language == "java":
        return sorted(found)
    outer = []
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if not outer or span[0] >= outer[-1][1]:
            outer.append(span)
    return outer


def _head(tokens: list[Token], brace: int, language: str, pairs: dict[int, int]) -> int | None:
    """The token at which the function whose body opens at brace starts, None if it is no function's."""
    if language == "typescript" and brace and tokens[brace - 1].text in (":", "|", "&"):
        return None  # a type
    i, keyword = brace - 1, {"go": "func", "php": "function", "rust": "fn"}.get(language)
    depth, bracket = 0, None
    while i >= 0:
        text = tokens[i].text
        if depth == 0 and text == "}" and language == "typescript" and pairs.get(i, 0) > 1 and tokens[pairs[i] - 1].text in (":", "|", "&", "<", ","):
            i = pairs[i] - 1  # a type
            continue
        if depth == 0 and text in (";", "}"):
            break
        if text in CLOSE:
            depth += 1
        elif text in OPEN:
            depth -= 1
            if depth < 0:
                break
            if depth == 0 and text == "(":
                bracket = i
        if depth == 0 and keyword and text == keyword:
            named = i + 1
            if language == "go" and tokens[named].text == "(":  # a receiver; without a name after it, a literal
                while tokens[named].text != ")" and named < brace:
                    named += 1
                named += 1
            return _with_modifiers(tokens, i) if tokens[named].kind == "name" and tokens[named + 1].text in ("(", "[", "<") else None
        if depth == 0 and language in ("javascript", "typescript") and text == "function":
            return _with_modifiers(tokens, i)
        i -= 1
    arrow = language in ("javascript", "typescript") and tokens[brace - 1].text == "=>"
    if arrow and bracket is None and tokens[brace - 2].kind == "name":
        bracket = brace - 2  # one parameter without brackets
    if keyword or bracket is None or bracket == 0 and not arrow:
        return None
    generic = _types(tokens, bracket - 1) if language in ("java", "typescript") else None
    if arrow:
        first = bracket if generic is None else generic
        return first - (first > 0 and tokens[first - 1].text == "async")
    if generic is not None and language == "typescript":
        bracket = generic
    name = tokens[bracket - 1]
    if name.kind != "name" or name.text in RESERVED[language] or name.text == "new":
        return None
    if language in ("java", "c") and not (bracket >= 2 and (tokens[bracket - 2].kind == "name" or tokens[bracket - 2].text in ("*", ">", "]", "&")) and tokens[bracket - 2].text not in ("new", "return", "else")):
        return None if language == "c" or bracket >= 2 and tokens[bracket - 2].text not in ("{", "}", ";") else bracket - 1
    return _with_modifiers(tokens, bracket - 1)


def _types(tokens: list[Token], i: int) -> int | None:
    """The token that opens the type parameters that end at i, if there are any."""
    if i < 1 or tokens[i].text not in (">", ">>"):
        return None
    depth = 0
    while i >= 0:
        depth += len(tokens[i].text) if tokens[i].text in (">", ">>") else -(tokens[i].text == "<")
        if depth == 0:
            return i
        if tokens[i].text in (";", "=>") or depth < 0:
            return None
        i -= 1
    return None


def _with_modifiers(tokens: list[Token], i: int) -> int:
    """Back over modifiers and the return type."""
    while i > 0 and (tokens[i - 1].kind == "name" and tokens[i - 1].text not in ("return", "else", "new", "default") or tokens[i - 1].text in ("*", "]", "[", ">", "<", "&", "@")):
        i -= 1
    return i


def methods(code: str, language: str) -> list[str]:
    return [code[a:b].strip() for a, b in method_spans(code, language)]


def statements(code: str, language: str) -> list[str]:
    """Texts of the top-level statements of the first function, or of the snippet; the whole snippet if there are none."""
    code = code.strip()
    return [t for n in Side(code, language).roots if (t := code[n.start : n.end].strip())] or ([code] if code else [])


def nodes(code: str, language: str) -> list[Node]:
    """The statements of the first function of code, or of all of it if there is none."""
    return Side(code, language).roots
