"""Why an archive is refused. The name is what status columns hold."""

from __future__ import annotations


class CodecError(ValueError):
    """An archive, an option or a size that the codec refuses; ``status`` names the reason."""

    def __init__(self, status: str, detail: str = ""):
        super().__init__(f"{status}: {detail}" if detail else status)
        self.status = status

    def __reduce__(self):
        return CodecError, (self.status, str(self).partition(": ")[2])


#: The reasons, with the message for people.
REASONS = {
    "BadMagic": "not an archive of this format",
    "InvalidLevel": "profile or level byte out of range",
    "InvalidEntropyData": "malformed entropy-coded data or flags",
    "InvalidBlockSize": "block size out of range",
    "Truncated": "input ends too early",
    "InvalidMatch": "malformed command, match or reference",
    "TrailingData": "bytes after the end",
    "UnsupportedMethod": "unknown method or predictor",
    "OutputLimitExceeded": "decoded size is over the limit",
    "LengthMismatch": "sizes do not agree",
    "ChecksumMismatch": "checksum of restored bytes differs",
    "InputTooLarge": "input is over the size a field can hold",
}


def refuse(status: str, detail: str = "") -> CodecError:
    return CodecError(status, detail or REASONS[status])
