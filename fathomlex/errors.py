"""The one error that queries, schemas and updates raise, always on the driver."""


class SearchError(Exception):
    """``code`` names the condition, ``detail`` says what met it."""

    def __init__(self, code: str, detail: object = ""):
        super().__init__(f"{code}: {detail}" if detail != "" else code)
        self.code, self.detail = code, detail
