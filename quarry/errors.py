"""One hierarchy of errors for everything a statement can get wrong."""


class QuarryError(Exception):
    """Any error that a statement can cause."""


class ParseError(QuarryError):
    """The text is no statement of the dialect."""

    def __init__(self, what: str, line: int, position: int, token: str):
        super().__init__(f"line {line}, position {position}: {what} (at '{token}')")
        self.line, self.position, self.token = line, position, token


class EngineError(QuarryError):
    """The statement is well formed, but names or values do not fit the tables."""
