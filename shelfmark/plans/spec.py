"""The logical plan of a search: a parsed conjunction of predicates."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class MatchMode(Enum):
    SUBSTRING = "Substring"
    FUZZY = "Fuzzy"
    REGEX = "Regex"

    @property
    def label(self) -> str:
        return self.value


class TypeFilter(Enum):
    ANY = "any"
    FILE = "file"
    FOLDER = "folder"


class Category(Enum):
    ALL = "All"
    FOLDERS = "Folders"
    FILES = "Files"
    DOCUMENTS = "Documents"
    IMAGES = "Images"
    AUDIO = "Audio"
    VIDEO = "Video"
    ARCHIVES = "Archives"
    CODE = "Code"
    EXECUTABLES = "Executables"

    @property
    def label(self) -> str:
        return self.value

    @property
    def extensions(self) -> tuple[str, ...]:
        return EXTENSIONS.get(self, ())


#: The extensions of each category.
EXTENSIONS = {
    Category.DOCUMENTS: tuple("pdf doc docx xls xlsx ppt pptx odt ods odp txt rtf md epub mobi csv tex pages numbers key".split()),
    Category.IMAGES: tuple("jpg jpeg png gif bmp webp tif tiff ico svg heic raw cr2 nef arw psd ai xcf".split()),
    Category.AUDIO: tuple("mp3 wav flac aac ogg wma m4a opus aiff mid midi".split()),
    Category.VIDEO: tuple("mp4 mkv avi mov wmv flv webm m4v mpg mpeg 3gp vob mts m2ts".split()),
    Category.ARCHIVES: tuple("zip rar 7z tar gz bz2 xz zst iso cab arj lz".split()),
    Category.CODE: tuple(
        "rs py js ts jsx tsx c h cpp hpp cc cs java kt go rb php swift sh bat ps1 cmd html htm css scss json xml yml yaml toml ini sql lua pl r dart scala zig vue svelte".split()
    ),
    Category.EXECUTABLES: tuple("exe msi dll sys com scr app deb rpm appimage apk jar bin so dylib".split()),
}
#: Further extensions of text files, images that can be shown, documents and media that can be read.
TEXT_EXTENSIONS = tuple("txt md log csv tsv cfg conf env rst properties gitignore editorconfig dockerfile makefile srt sub vtt nfo reg inf diff patch".split())
IMAGE_EXTENSIONS = tuple("jpg jpeg png gif bmp webp ico tif tiff".split())
DOCUMENT_EXTENSIONS = tuple("pdf docx pptx xlsx xls xlsm odt odp ods".split())
MEDIA_EXTENSIONS = tuple("mp4 mov m4v m4a mkv webm avi wmv flv mp3 flac wav ogg opus aac".split())


class SortKey(Enum):
    RELEVANCE = "relevance"
    NAME = "name"
    PATH = "path"
    SIZE = "size"
    MODIFIED = "modified"


@dataclass(frozen=True)
class SortState:
    """Column header clicks: a new key sorts descending, then ascending, then back to relevance."""

    key: SortKey = SortKey.RELEVANCE
    descending: bool = True

    def click(self, key: SortKey) -> SortState:
        if key is not self.key:
            return SortState(key, True)
        return SortState(key, False) if self.descending else SortState()


@dataclass(frozen=True)
class SearchSpec:
    """What a query asks for. Bounds are None where there is none; ``date_max`` is exclusive."""

    terms: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    size_min: int | None = None
    size_max: int | None = None
    date_min: int | None = None
    date_max: int | None = None
    type: TypeFilter = TypeFilter.ANY
    content: str | None = None
    mode: MatchMode = MatchMode.SUBSTRING
    case_sensitive: bool = False

    @property
    def is_empty(self) -> bool:
        bounds = (self.size_min, self.size_max, self.date_min, self.date_max)
        return not (self.terms or self.extensions or self.paths or self.content) and all(b is None for b in bounds) and self.type is TypeFilter.ANY

    @property
    def needs_path(self) -> bool:
        return bool(self.paths)
