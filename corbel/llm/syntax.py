"""Problem 3: source files that do not parse: lexers, the verdict of a file, and rates.

Each file is lexed and its tokens are run through memoised derivatives of its language's grammar: an empty derivative
marks the failing token, an end that is not nullable means that the file is cut off.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.derivatives import language

# What the extensions name.
EXTENSIONS = {".py": "python", ".pyi": "python", ".json": "json", ".toml": "toml"}


class LexError(Exception):
    """A fault no token can be made of; ``truncated`` where the text ends inside a token, a bracket or a joined line."""

    def __init__(self, line: int, why: str, truncated: bool = False) -> None:
        super().__init__(why)
        self.line, self.truncated = line, truncated


def _decode_python(content: bytes) -> str:
    """Text by the rules for source encodings: byte order mark, coding comment, UTF-8 otherwise."""
    try:
        encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
        text = content.decode(encoding)
    except (SyntaxError, LookupError, UnicodeError, ValueError) as e:
        raise LexError(1, "encoding") from e
    if "\0" in text:
        raise LexError(text[: text.index("\0")].count("\n") + 1, "null byte")
    return text.replace("\r\n", "\n").replace("\r", "\n")


_ESCAPE = re.compile(r"\\[xuUN]")
_PREFIX = re.compile(r"[A-Za-z]*")


def _literal(token: str, line: int) -> str:
    """Kind of a string token; escapes that are not valid raise."""
    prefix = _PREFIX.match(token)[0].lower()
    kind = "BYTES" if "b" in prefix else "STR"
    if (kind == "BYTES" and not token.isascii()) or ("r" not in prefix and _ESCAPE.search(token)):
        try:
            ast.literal_eval(token)
        except (SyntaxError, ValueError) as e:
            raise LexError(line, "string literal") from e
    return kind


_BAD_NUMBER = re.compile(r"0[0_]*[1-9][0-9_]*")  # leading zeros


_CUT_NUMBER = re.compile(r"(?:\b0[xXbBoO]|[0-9a-fA-F]_|[0-9][eE][-+]?)\Z")  # digits must follow
_WHOLE = set(")]},;~")  # signs that begin no longer one, or close something


def _python_tokens(content: bytes, code: dict[str, int]) -> Iterator[tuple[int, int]]:
    """Codes and lines. Tokens that the text's end supplies or may have cut have negative lines: the line feed of a last
    line without one, what closes blocks there, and a word or sign that might go on."""
    text = _decode_python(content)
    final = text.count("\n") + 1
    end = (final, len(text) - text.rfind("\n") - 1)
    name, newline, indent, dedent = code["<NAME>"], code["<NEWLINE>"], code["<INDENT>"], code["<DEDENT>"]
    N, O, NL, C = tokenize.NAME, tokenize.OP, tokenize.NL, tokenize.COMMENT  # noqa: E741
    line, raw = 1, []
    try:
        for kind, string, start, stop, _ in tokenize.generate_tokens(io.StringIO(text).readline):
            if kind == NL or kind == C:
                continue
            line = start[0]
            if kind == N:
                if not string.isascii() and not string.isidentifier():
                    raise LexError(line, "character")
                yield code.get(string, name), -line if stop == end else line
            elif kind == O:
                known = code.get(string)
                if known is None:
                    raise LexError(line, "character")
                yield known, -line if stop == end and string not in _WHOLE else line
            elif kind == tokenize.NEWLINE:
                yield newline, line if string else -line
            elif kind == tokenize.STRING:
                yield code[f"<{_literal(string, line)}>"], line
            elif kind == tokenize.NUMBER:
                if _BAD_NUMBER.fullmatch(string) or len(string) > 4300 and string.isdigit():
                    raise LexError(line, "number")
                yield code["<IMAG>" if string[-1] in "jJ" else "<NUMBER>"], line
            elif kind == tokenize.INDENT:
                yield indent, line
            elif kind == tokenize.DEDENT:
                yield dedent, line if start[0] < final or text[-1:] not in ("", "\n") and start[1] else -line
            elif kind == tokenize.FSTRING_START:
                raw.append("r" in string.lower())
                yield code["<FSTART>"], line
            elif kind == tokenize.FSTRING_MIDDLE:
                if not raw[-1] and _ESCAPE.search(string):
                    _literal('"""' + string.replace('"', "'") + ' """', line)
                yield code["<FMID>"], line
            elif kind == tokenize.FSTRING_END:
                raw.pop()
                yield code["<FEND>"], line
            elif kind != tokenize.ENDMARKER:
                raise LexError(line, "character")
    except (tokenize.TokenError, SyntaxError) as e:
        at = e.args[1] if len(e.args) > 1 else None
        where = at[0] if isinstance(at, tuple) and isinstance(at[0], int) else at[1] if isinstance(at, tuple) and len(at) > 1 and isinstance(at[1], int) else line
        # A string of one line that the text's end leaves open was perhaps to be closed.
        open_end = "EOF" in str(e) or "was never closed" in str(e) or "unterminated triple" in str(e) or where == final and ("unterminated" in str(e) or _CUT_NUMBER.search(text) is not None)
        raise LexError(where, "token", open_end) from e


_JSON = re.compile(r'[ \t\n\r]*(?:([][{}:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.+-])|(\Z))')


def _text_of(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        raise LexError(content[: e.start].count(b"\n") + 1, "encoding") from e


def _json_tokens(content: bytes, code: dict[str, int]) -> Iterator[tuple[int, int]]:
    text, at = _text_of(content).removeprefix("﻿"), 0
    while True:
        m = _JSON.match(text, at)
        if m is None:
            rest = text[at:].lstrip(" \t\n\r")
            raise LexError(text.count("\n", 0, len(text) - len(rest)) + 1, "token", rest.startswith('"') and re.match(r'"(?:[^"\\\x00-\x1f]|\\.)*\\?\Z', rest) is not None)
        at = m.end()
        if m[4] is not None:
            return
        yield code[m[1] or ("STRING" if m[2] else "ATOM")], at
        if at == len(text):
            return


_BASIC = r'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"'
_LITERAL = r"'[^'\x00-\x08\x0a-\x1f\x7f]*'"
_MULTI = r'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|"{1,2}(?!")|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\n[ \t\n]*))*"{3,5}'
_MULTI_LITERAL = r"'''(?:[^'\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|'{1,2}(?!'))*'{3,5}"
_TIME = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
_DATE = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_NUMBER = r"0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?"
_TOML_SPACE = re.compile(r"[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*)?")
_TOML_KEY = re.compile(rf"({_BASIC}|{_LITERAL})|([A-Za-z0-9_-]+)|([.=\]}},])")
_TOML_VALUE = re.compile(rf"({_MULTI}|{_MULTI_LITERAL})|({_BASIC}|{_LITERAL})|({_DATE}(?:[Tt ]{_TIME}(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?|{_TIME}|true|false|{_NUMBER})(?![\w.:+-])|([\[\]{{}},])")


def _toml_tokens(content: bytes, code: dict[str, int]) -> Iterator[tuple[int, int]]:
    """Keys and values look alike, so the lexer keeps whether a value is due: after ``=`` and in arrays."""
    text, at, line = _text_of(content).replace("\r\n", "\n"), 0, 1
    nest: list[str] = []
    due = head = False
    fresh = True
    while True:
        at = _TOML_SPACE.match(text, at).end()
        if at == len(text):
            return
        if text[at] == "\n":
            yield code["NL"], line
            at, line, fresh = at + 1, line + 1, True
            due = bool(nest) and nest[-1] == "["
            head = False
            continue
        if fresh and not nest and not due and text[at] == "[":
            two = text.startswith("[[", at)
            yield code["[[" if two else "[t"], line
            at, head, fresh = at + 1 + two, True, False
            continue
        fresh = False
        m = (_TOML_VALUE if due else _TOML_KEY).match(text, at)
        if m is None:
            raise LexError(line, "token", text[at] in "\"'" and "\n" not in text[at:] or text.startswith(('"""', "'''"), at))
        s = m[0]
        if due:
            mark = m[4]
            if mark in ("[", "{"):
                nest.append(mark)
                due = mark == "["
            elif mark in ("]", "}"):
                if nest:
                    nest.pop()
                due = bool(nest) and nest[-1] == "["
            elif mark is None and not (nest and nest[-1] == "["):
                due = False
            yield code["MULTI" if m[1] else "STR" if m[2] else "ATOM" if m[3] else mark], line
            at = m.end()
            line += s.count("\n")
            continue
        if head and s == "]":
            two = text.startswith("]]", at)
            yield code["]]" if two else "]t"], line
            at, head = at + 1 + two, False
            continue
        if m[3]:
            if s == "=":
                due = True
            elif s == "}" and nest:
                nest.pop()
                due = bool(nest) and nest[-1] == "["
            yield code[s], line
        else:
            yield code["STR" if m[1] else "KEY"], line
        at = m.end()


_LEXERS = {"python": _python_tokens, "json": _json_tokens, "toml": _toml_tokens}


def verdict(name: str, content: bytes) -> tuple[str | None, int | None]:
    """``(reason, line)`` of the first fault of a file, (None, None) if it is valid.

    Reasons: encoding, lexical (no token here), token (no derivative by this token), truncated: all tokens that the text
    has were read, but the derivative at its end is not nullable. A text that ends inside a token, a bracket or a joined
    line ends there for the parser, too; a last word without a line end may be cut itself.
    """
    g, start = language(name)
    lines: list[int] = []
    ended: list[int] = []  # the line at which the text broke off inside something

    def codes():
        try:
            for c, line in _LEXERS[name](content, g.tokens):
                lines.append(line)
                yield c
        except LexError as e:
            if not e.truncated:
                raise
            ended.append(e.line)

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            read, complete = g.parse(start, codes())
    except LexError as e:
        return "encoding" if str(e) == "encoding" else "lexical", e.line
    if complete and not ended:
        return None, None
    # Whether the failing token, the last one made, is of the text's end.
    over = read == len(lines) or lines[read] < 0
    line = ended[-1] if ended and over else abs(lines[-1]) if lines else 1
    if name == "json" and lines:  # its lexer gives places, not lines
        line = content.decode("utf-8", "replace").count("\n", 0, line) + 1
    return ("truncated" if over else "token"), line


def flag_files(files: DataFrame, id_col: str = "id", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``(file_id, language, invalid, reason, line)`` of each row; ``language`` is what the path's extension names.

    Other extensions, null paths and null contents have language or verdict null and are not invalid. An empty Python or
    TOML file is valid, an empty JSON file is not. One scan, no shuffle; only files of known languages go to Python.
    Repeated rows come out as often as they come in; an empty table gives an empty result.
    """
    ext = F.lower(F.regexp_extract(F.coalesce(F.col(path_col), F.lit("")), r"(\.[^./\\]+)$", 1))
    lang = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    rows = files.select(F.col(id_col).cast("bigint").alias("file_id"), lang.alias("language"), F.col(content_col).cast("binary").alias("content"))
    known = F.col("language").isNotNull() & F.col("content").isNotNull()

    def run(batches):
        for b in batches:
            found = [verdict(name, data) for name, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            reason, line = [r for r, _ in found], [x for _, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r is not None for r in reason], pa.bool_()), pa.array(reason, pa.string()), pa.array(line, pa.int32())], names=["file_id", "language", "invalid", "reason", "line"])

    checked = rows.where(known).mapInArrow(run, "file_id bigint, language string, invalid boolean, reason string, line int")
    others = rows.where(~known).select("file_id", "language", F.lit(False).alias("invalid"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("line"))
    return checked.unionByName(others)


def invalid_rates(files: DataFrame, repo_col: str = "repo_id") -> DataFrame:
    """``(repo_id, language, files, invalid_files, rate)`` over files of known languages with content."""
    flags = flag_files(files.select(F.struct("id", repo_col).alias("k"), "path", "content").select(F.col("k.id").alias("id"), "path", "content"))
    repos = files.where(F.col("content").isNotNull()).select(F.col("id").cast("bigint").alias("file_id"), F.col(repo_col).alias("repo_id")).distinct()
    joined = flags.where(F.col("language").isNotNull()).distinct().join(repos, "file_id")
    bad = F.sum(F.col("invalid").cast("bigint"))
    return joined.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("invalid_files"), (bad / F.count(F.lit(1))).alias("rate"))
