"""The dialect: lexer, parser and syntax tree."""

from tidewell.sql.parser import parse
from tidewell.sql.tree import DialectError

__all__ = ["DialectError", "parse"]
