"""Errors that name what the caller got wrong."""


class RequestError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
