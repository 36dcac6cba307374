"""What can go wrong, by kind."""


class FolioError(Exception):
    """Base of all errors this library raises on purpose."""


class ConfigError(FolioError):
    """A setting is missing or makes no sense."""


class PreconditionError(FolioError):
    """Something a run needs isn't there."""


class WorkspaceError(FolioError):
    """A workspace can't be read or written."""


class SerializationError(FolioError):
    """A project doesn't have the stored form."""


class MigrationError(SerializationError):
    """A stored version can't be brought to the present one."""


class ProviderError(FolioError):
    """An external provider failed."""


class LanguageProviderError(ProviderError):
    """A language provider failed; `malformed` if it answered, but not in the agreed form."""

    def __init__(self, *args: object, malformed: bool = False):
        super().__init__(*args)
        self.malformed = malformed


class SpeechProviderError(ProviderError):
    """A speech provider failed."""


class EbookParseError(FolioError):
    """A book can't be parsed."""


class StageError(FolioError):
    """A stage failed."""


class StoppedError(FolioError):
    """A stop was asked for in the middle of a stage."""


class AssemblyError(FolioError):
    """The finished audiobook can't be put together."""
