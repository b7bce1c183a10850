"""Errors that a request meets before any job starts."""


class QueryError(Exception):
    """The text is malformed. `position` is an offset into it."""

    status = 400

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} (at {position})")
        self.position = position


class UnsupportedError(QueryError):
    """The text is understood, but names something that is rejected on purpose."""

    status = 422


class LimitError(QueryError):
    """The request asks for more than its limits allow."""

    status = 422
