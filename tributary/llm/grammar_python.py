"""Python 3: tokens, with indentation and formatted strings, and grammar."""

from __future__ import annotations

import re

GRAMMAR = """
file: NEWLINE* (statement NEWLINE*)*
statements: statement+
statement: compound / simple_line
simple_line: simple (';' simple)* ';'? NEWLINE
simple: assignment / star_expressions / return / import / raise / 'pass' / del / yield / assert / 'break' / 'continue' / global / type_alias
assignment: NAME ':' expression ('=' (yield / star_expressions))? / single_target ':' expression ('=' (yield / star_expressions))? / (star_targets '=')+ (yield / star_expressions) !'=' / single_target AUGMENT (yield / star_expressions)
return: 'return' star_expressions?
raise: 'raise' (expression ('from' expression)?)?
global: ('global' / 'nonlocal') NAME (',' NAME)*
del: 'del' del_targets &(';' / NEWLINE)
assert: 'assert' expression (',' expression)?
type_alias: 'type' NAME type_params? '=' expression
import: 'import' dotted_as (',' dotted_as)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' import_names
import_names: '*' / '(' import_as (',' import_as)* ','? ')' / import_as (',' import_as)* !','
dotted_as: dotted ('as' NAME)?
import_as: NAME ('as' NAME)?
dotted: NAME ('.' NAME)*
compound: decorated / function / class / if / for / while / try / with / async / match
block: NEWLINE INDENT statements DEDENT / simple_line
decorated: ('@' named NEWLINE)+ (class / function / async_function)
class: 'class' NAME type_params? ('(' arguments? ')')? ':' block
function: 'def' NAME type_params? '(' parameters? ')' ('->' expression)? ':' block
async_function: 'async' function
async: 'async' (function / for / with)
type_params: '[' type_param (',' type_param)* ','? ']'
type_param: NAME (':' expression)? ('=' expression)? / '*' NAME ('=' star_expression)? / '**' NAME ('=' expression)?
parameters: parameter_list &')'
parameter_list: positional (',' star_etc)? ','? / star_etc ','?
positional: bare (',' bare)* (',' '/' (',' bare)* (',' defaulted)* / (',' defaulted)+ (',' '/' (',' defaulted)*)?)? / defaulted (',' defaulted)* (',' '/' (',' defaulted)*)?
bare: NAME (':' expression)? !'='
defaulted: NAME (':' expression)? '=' expression
parameter: NAME (':' expression)? ('=' expression)?
star_etc: '*' NAME (':' star_expression)? (',' parameter)* (',' double_star)? / '*' (',' parameter)+ (',' double_star)? / double_star
double_star: '**' NAME (':' expression)?
lambda: 'lambda' lambda_parameters? ':' expression
lambda_parameters: lambda_list ','?
lambda_list: lambda_positional (',' lambda_star)? / lambda_star
lambda_positional: lambda_bare (',' lambda_bare)* (',' '/' (',' lambda_bare)* (',' lambda_defaulted)* / (',' lambda_defaulted)+ (',' '/' (',' lambda_defaulted)*)?)? / lambda_defaulted (',' lambda_defaulted)* (',' '/' (',' lambda_defaulted)*)?
lambda_bare: NAME !'='
lambda_defaulted: NAME '=' expression
lambda_parameter: NAME ('=' expression)?
lambda_star: '*' NAME (',' lambda_parameter)* (',' '**' NAME)? / '*' (',' lambda_parameter)+ (',' '**' NAME)? / '**' NAME
if: 'if' named ':' block ('elif' named ':' block)* else?
else: 'else' ':' block
while: 'while' named ':' block else?
for: 'for' star_targets 'in' star_expressions ':' block else?
with: 'with' ('(' with_item (',' with_item)* ','? ')' ':' block / with_item (',' with_item)* ':' block)
with_item: expression 'as' star_target &(',' / ')' / ':') / expression
try: 'try' ':' block (finally / (except_star+ / except+) else? finally?)
except: 'except' (expression ('as' NAME)?)? ':' block
except_star: 'except' '*' expression ('as' NAME)? ':' block
finally: 'finally' ':' block
match: 'match' subject ':' NEWLINE INDENT case+ DEDENT
subject: star_named ',' star_named_list? / named
case: 'case' patterns guard? ':' block
guard: 'if' named
patterns: open_sequence / pattern
pattern: or_pattern ('as' NAME)?
or_pattern: closed_pattern ('|' closed_pattern)*
closed_pattern: literal_pattern / class_pattern / value_pattern / NAME / '(' pattern ')' / sequence_pattern / mapping_pattern
literal_pattern: signed (('+' / '-') NUMBER)? / STRING+ / fstring / 'None' / 'True' / 'False'
signed: '-'? NUMBER
value_pattern: NAME ('.' NAME)+
class_pattern: NAME ('.' NAME)* '(' (class_argument (',' class_argument)* ','?)? ')'
class_argument: NAME '=' pattern / pattern
sequence_pattern: '[' (maybe_star (',' maybe_star)* ','?)? ']' / '(' open_sequence? ')'
open_sequence: maybe_star ',' (maybe_star (',' maybe_star)* ','?)?
maybe_star: '*' NAME / pattern
mapping_pattern: '{' (mapping_item (',' mapping_item)* ','?)? '}'
mapping_item: '**' NAME / (literal_pattern / value_pattern) ':' pattern
star_expressions: star_expression (',' star_expression)* ','?
star_expression: '*' bit_or / expression
star_named_list: star_named (',' star_named)* ','?
star_named: '*' bit_or / named
named: NAME ':=' expression / expression !':='
yield: 'yield' ('from' expression / star_expressions)?
expression: lambda / disjunction ('if' disjunction 'else' expression)?
disjunction: conjunction ('or' conjunction)*
conjunction: inversion ('and' inversion)*
inversion: 'not' inversion / comparison
comparison: bit_or (comparator bit_or)*
comparator: COMPARE / 'in' / 'not' 'in' / 'is' 'not'?
bit_or: bit_xor ('|' bit_xor)*
bit_xor: bit_and ('^' bit_and)*
bit_and: shift ('&' shift)*
shift: sum (SHIFT sum)*
sum: term (('+' / '-') term)*
term: factor (('*' / '/' / '//' / '%' / '@') factor)*
factor: ('+' / '-' / '~') factor / power
power: await ('**' factor)?
await: 'await' primary / primary
primary: atom trailer*
trailer: '.' NAME / '(' arguments? ')' / '[' slices ']'
slices: slice (',' slice)* ','?
slice: expression? ':' expression? (':' expression?)? / star_named
atom: NAME / 'True' / 'False' / 'None' / strings / NUMBER / '...' / group / list / braces
group: '(' (yield / named comprehension / star_named ',' star_named_list? / named)? ')'
list: '[' (named comprehension / star_named_list)? ']'
braces: '{' (dict_item (comprehension / (',' dict_item)* ','?) / named comprehension / star_named_list)? '}'
dict_item: '**' bit_or / expression ':' expression
comprehension: ('async'? 'for' star_targets 'in' disjunction ('if' disjunction_or_named)*)+
disjunction_or_named: NAME ':=' expression / disjunction
strings: (STRING / fstring)+
fstring: FSTART fpart* FEND
fpart: FTEXT / '{' fvalue '}'
fvalue: (yield / star_expressions) '='? ('!' NAME)? (':' FSPEC fpart* )?
arguments: (plain_argument (',' plain_argument)* (',' keywords)? / keywords) ','? &')'
plain_argument: '*' expression / named comprehension &(')') / !(NAME '=') named !'='
keywords: (NAME '=' expression / '*' expression) (',' (NAME '=' expression / '*' expression))* (',' (NAME '=' expression / '**' expression))* / (NAME '=' expression / '**' expression) (',' (NAME '=' expression / '**' expression))*
star_targets: star_target (',' star_target)* ','?
star_target: '*' plain_target / plain_target
plain_target: long_target / NAME !target_more / '(' star_targets? ')' !target_more / '[' star_targets? ']' !target_more
single_target: long_target / NAME !target_more / '(' single_target ')'
long_target: atom (trailer &target_more)* ('.' NAME / '[' slices ']') !target_more
target_more: '(' / '[' / '.'
del_targets: plain_target (',' plain_target)* ','?
"""

# The reserved words of the language.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_SOFT = {"match": 5, "case": 4, "type": 4}
_NO_SOFT = {"=", ".", ":", ",", ")", "]", "AUGMENT", ":=", "COMPARE", ";", "NEWLINE"}
_COMPARE = {"==", "!=", "<", ">", "<=", ">="}
_SHIFTS = {"<<", ">>"}
_AUGMENTS = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}

_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
_OPERATOR = r"\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|>>|<<|[-+*/%@&|^<>=!]=|[-+*/%@&|^~<>()\[\]{},:.;=!]"
_TOKEN = re.compile(rf"(?P<blank>[ \t\f]+|\\\r?\n)|(?P<comment>#[^\r\n]*)|(?P<newline>\r?\n|\r)|(?P<string>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''|\"\"\"|'|\"))|(?P<fstring>(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|\"))|(?P<number>{_NUMBER})|(?P<name>[^\W\d]\w*)|(?P<op>{_OPERATOR})")
_BODY = {
    "'": re.compile(r"(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"), '"': re.compile(r'(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"'),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"), '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
}
_AFTER_NUMBER = ("and", "else", "for", "if", "in", "is", "not", "or")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Unlexable(Exception):
    """A text that has no tokens; the offset and the cause."""

    def __init__(self, at: int, cause: str):
        self.at, self.cause = at, cause


class _Lexer:
    def __init__(self, text: str):
        self.text, self.kinds, self.at = text, [], []
        self.indents, self.alternate = [0], [0]
        self.brackets: list[str] = []

    def put(self, kind: str, at: int) -> None:
        self.kinds.append(kind)
        self.at.append(at)

    def run(self) -> None:
        text, pos, n = self.text, 0, len(self.text)
        if text.startswith("﻿"):
            pos = 1
        line_start = True
        while pos < n:
            if line_start and not self.brackets:
                begin = pos
                column = alt = 0
                while pos < n and text[pos] in " \t\f":
                    c = text[pos]
                    column = 0 if c == "\f" else column + 1 if c == " " else column + 8 - column % 8
                    alt = 0 if c == "\f" else alt + 1
                    pos += 1
                if pos < n and text[pos] not in "#\r\n" and not (text[pos] == "\\" and text[pos + 1 : pos + 2] in ("\n", "\r")):
                    self.indent(column, alt, begin)
                line_start = False
                continue
            pos, line_start = self.one(pos, n)
        if self.brackets:
            raise Unlexable(n, "unclosed bracket")
        if self.kinds and self.kinds[-1] != "NEWLINE":
            self.put("NEWLINE", n)
        for _ in self.indents[1:]:
            self.put("DEDENT", n)
        self.put("EOF", n)

    def indent(self, column: int, alt: int, at: int) -> None:
        if column == self.indents[-1]:
            if alt != self.alternate[-1]:
                raise Unlexable(at, "indentation")
            return
        if column > self.indents[-1]:
            if alt <= self.alternate[-1] or len(self.indents) >= 100:
                raise Unlexable(at, "indentation")
            self.indents.append(column)
            self.alternate.append(alt)
            self.put("INDENT", at)
            return
        while column < self.indents[-1]:
            self.indents.pop()
            self.alternate.pop()
            self.put("DEDENT", at)
        if column != self.indents[-1] or alt != self.alternate[-1]:
            raise Unlexable(at, "indentation")

    def one(self, pos: int, n: int) -> tuple[int, bool]:
        """One token at pos; the next position, and whether a line starts there."""
        text = self.text
        m = _TOKEN.match(text, pos)
        if m is None:
            raise Unlexable(pos, "character")
        kind, value, end = m.lastgroup, m.group(), m.end()
        if kind == "blank":
            if value[0] == "\\" and end >= n:
                raise Unlexable(pos, "end of file")
            return end, False
        if kind == "comment":
            return end, False
        if kind == "newline":
            if self.brackets:
                return end, False
            if self.kinds and self.kinds[-1] not in ("NEWLINE", "INDENT", "DEDENT"):
                self.put("NEWLINE", pos)
            return end, True
        if kind == "name":
            if not value.isidentifier():
                raise Unlexable(pos, "character")
            self.put(value if value in KEYWORDS else "NAME", pos)
        elif kind == "number":
            self.number(value, pos, end)
        elif kind == "string":
            quote = value.lstrip("rRbBuU")
            body = _BODY[quote].match(text, end)
            if body is None:
                raise Unlexable(pos, "unterminated string")
            if "b" in value.lower() and not body.group().isascii():
                raise Unlexable(pos, "character")
            self.put("STRING", pos)
            end = body.end()
        elif kind == "fstring":
            end = self.formatted(value, pos, end)
        else:
            self.operator(value, pos)
        return end, False

    def number(self, value: str, pos: int, end: int) -> None:
        rest = re.match(r"\w+", self.text[end : end + 20])
        if rest and not rest.group().startswith(_AFTER_NUMBER):
            raise Unlexable(pos, "number")
        if re.fullmatch(r"0[\d_]*[1-9][\d_]*", value):
            raise Unlexable(pos, "number")
        self.put("NUMBER", pos)

    def operator(self, value: str, pos: int) -> None:
        if value in _OPEN:
            if len(self.brackets) >= 200:
                raise Unlexable(pos, "nesting")
            self.brackets.append(value)
        elif value in _CLOSE:
            if not self.brackets or self.brackets[-1] != _CLOSE[value]:
                raise Unlexable(pos, "unmatched bracket")
            self.brackets.pop()
        self.put("COMPARE" if value in _COMPARE else "SHIFT" if value in _SHIFTS else "AUGMENT" if value in _AUGMENTS else value, pos)

    def formatted(self, value: str, pos: int, end: int) -> int:
        """The tokens of a formatted string; the position after it."""
        quote = value.lstrip("fFrR")
        raw = "r" in value.lower()
        self.put("FSTART", pos)
        end = self.literal(pos, end, quote, raw, False)
        self.put("FEND", end)
        return end + len(quote)

    def literal(self, begin: int, pos: int, quote: str, raw: bool, spec: bool) -> int:
        """Literal parts and fields up to the quote (or, in a format specification, the brace) that ends them."""
        text, n = self.text, len(self.text)
        while True:
            if pos >= n:
                raise Unlexable(begin, "unterminated string")
            c = text[pos]
            if text.startswith(quote, pos):
                if spec:
                    raise Unlexable(pos, "formatted string")
                return pos
            if c in "\r\n" and len(quote) == 1:
                raise Unlexable(begin, "unterminated string")
            if c == "\\":
                if not raw and text[pos + 1 : pos + 3] == "N{":
                    close = text.find("}", pos)
                    if close < 0:
                        raise Unlexable(pos, "formatted string")
                    pos = close + 1
                else:
                    pos += 1 if text[pos + 1 : pos + 2] in ("{", "}") else 3 if text.startswith("\r\n", pos + 1) else 2
            elif c == "{":
                if text.startswith("{{", pos) and not spec:
                    pos += 2
                else:
                    pos = self.field(pos, quote, raw)
            elif c == "}":
                if spec:
                    return pos
                if not text.startswith("}}", pos):
                    raise Unlexable(pos, "formatted string")
                pos += 2
            else:
                pos += 1

    def field(self, pos: int, quote: str, raw: bool) -> int:
        text, n = self.text, len(self.text)
        self.put("{", pos)
        outer, self.brackets = self.brackets, ["{"]
        pos += 1
        while True:
            if pos >= n:
                raise Unlexable(pos, "unterminated string")
            c = text[pos]
            if len(self.brackets) == 1:
                if c == "}":
                    self.put("}", pos)
                    break
                if c == "!" and text[pos + 1 : pos + 2] != "=":
                    self.put("!", pos)
                    pos += 1
                    continue
                if c == ":" and self.kinds[-1] != "lambda":
                    self.put(":", pos)
                    self.put("FSPEC", pos)
                    pos = self.literal(pos, pos + 1, quote, raw, True)
                    self.put("}", pos)
                    break
            pos, _ = self.one(pos, n)
        self.brackets = outer
        return pos + 1


def tokens(text: str) -> tuple[list[str], list[int], str]:
    """(token classes, offsets, cause of a lexical failure)."""
    lexer = _Lexer(text)
    cause = ""
    try:
        if "\x00" in text:
            raise Unlexable(text.index("\x00"), "character")
        lexer.run()
    except Unlexable as error:
        cause = error.cause
        lexer.put("BAD", error.at)
        lexer.put("EOF", error.at)
    if any(word in text for word in _SOFT):
        _soften(text, lexer.kinds, lexer.at)
    return lexer.kinds, lexer.at, cause


def _soften(text: str, kinds: list[str], at: list[int]) -> None:
    """Mark words that are reserved at the start of some statements only."""
    start = True
    for i, kind in enumerate(kinds):
        if start and kind == "NAME":
            word = next((w for w, n in _SOFT.items() if text.startswith(w, at[i]) and not text[at[i] + n : at[i] + n + 1].isidentifier() and not text[at[i] + n : at[i] + n + 1].isdigit()), None)
            if word and kinds[i + 1] not in _NO_SOFT:
                if word == "type":
                    if kinds[i + 1] == "NAME":
                        kinds[i] = word
                else:
                    depth, j, colon = 0, i + 1, -1
                    while kinds[j] not in ("NEWLINE", "EOF"):
                        depth += (kinds[j] in _OPEN) - (kinds[j] in _CLOSE)
                        if kinds[j] == ":" and depth == 0:
                            colon = j
                            if word == "case":
                                break
                        j += 1
                    if colon > i + 1 and (word == "case" or colon == j - 1):
                        kinds[i] = word
        start = kind in ("NEWLINE", "INDENT", "DEDENT", ";", ":")
