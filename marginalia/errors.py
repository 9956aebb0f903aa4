"""Errors with a stable code, for callers that answer requests."""


class EngineError(ValueError):
    """Invalid input or state; ``code`` is the status a service would answer with."""

    def __init__(self, message: str, code: int = 400):
        super().__init__(message)
        self.code = code
