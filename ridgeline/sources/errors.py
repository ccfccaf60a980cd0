class RasterError(Exception):
    """Anything wrong with a grid file."""


class UnsupportedFormat(RasterError):
    """The format is known by name only, or not at all."""


class AmbiguousFormat(RasterError):
    """Several formats have this extension and the content doesn't tell."""


class HeaderError(RasterError):
    """A header that lacks what it needs, or says what can't be."""


class DataError(RasterError):
    """Fewer or other values than the header promises."""


class OverwriteError(RasterError):
    """The target exists and overwriting wasn't asked for."""


class MissingFile(RasterError, FileNotFoundError):
    """There is no such file."""


class DeleteError(RasterError):
    """A file that is to be replaced can't be removed."""


class WriteError(RasterError):
    """The target can't be written."""
