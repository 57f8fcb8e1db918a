"""Errors of the dialect, each with its number."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all; `code` is the error's number."""

    code = 1000

    def __init__(self, message: str = ""):
        super().__init__(f"{type(self).__name__} [{self.code}]" + (f": {message}" if message else ""))


def _error(name: str, code: int, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "__doc__": doc, "__module__": __name__})


# Error numbers.
InternalError = _error("InternalError", 1001, "A state that can't be.")
NotImplementedYet = _error("NotImplementedYet", 1011, "A statement without an implementation.")
InvalidState = _error("InvalidState", 1012, "A statement out of place, such as a second BEGIN.")
DatabaseNotFound = _error("DatabaseNotFound", 3000, "No such database.")
DatabaseAlreadyExists = _error("DatabaseAlreadyExists", 3001, "A database of this name exists.")
TableNotFound = _error("TableNotFound", 4000, "No such table.")
TableAlreadyExists = _error("TableAlreadyExists", 4001, "A table of this name exists.")
MissingPrimaryKey = _error("MissingPrimaryKey", 4004, "The named primary key isn't a column.")
ColumnNotFound = _error("ColumnNotFound", 5000, "No such column.")
ColumnAlreadyExists = _error("ColumnAlreadyExists", 5001, "A column name twice in one table.")
ColumnTypeMismatch = _error("ColumnTypeMismatch", 5002, "A column of a type that isn't allowed here.")
AmbiguousColumn = _error("AmbiguousColumn", 5004, "A name that several tables have.")
IndexTypeError = _error("IndexTypeError", 6004, "An index over a type that isn't allowed.")
SyntaxFault = _error("SyntaxFault", 9000, "Text that isn't a statement.")
TypeMismatch = _error("TypeMismatch", 9004, "Operands or values of different types.")
UnsupportedOperation = _error("UnsupportedOperation", 9005, "A statement that is parsed but not offered.")
ValuesCountMismatch = _error("ValuesCountMismatch", 9006, "As many values as columns are needed.")
RecordTooLarge = _error("RecordTooLarge", 12000, "A row that is larger than a record may be.")


class TransactionAborted(EngineError):
    """A conflict with another transaction: the whole transaction is rolled back."""

    code = 1012


class Conflict(EngineError):
    """Another engine has committed first."""

    code = 1012
