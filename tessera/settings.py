"""Settings of a run: folders, formats, segmentation, registration and windows of interest."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def folder(path: str) -> str:
    """A folder's path with one slash at its end and none doubled."""
    return re.sub("/+", "/", path + "/")


@dataclass(frozen=True)
class Folders:
    """Where images are read and results are kept; results never go beside raw images but into ``savedOutput`` there."""

    raw: str
    adjusted: str = ""
    masks: str = ""
    registered: str = ""
    windows: str = ""

    def resolved(self) -> Folders:
        names = ("adjusted", "masks", "registered", "windows")
        own = [folder(getattr(self, n) or self.raw) for n in names]
        if folder(self.raw) in own:
            return Folders(folder(self.raw), *[folder(self.raw + "/savedOutput")] * 4)
        return Folders(folder(self.raw), *own)


@dataclass(frozen=True)
class Segmentation:
    scale: float = 1.0
    grow_back: bool = False
    version: str = ""
    check_twice: bool = False


@dataclass(frozen=True)
class Registration:
    points_a_side: int = 20
    pad: int = 200


@dataclass(frozen=True)
class Windows:
    """Windows of interest, and the radii that circle packing takes from them."""

    count: int = 8
    height: int = 600
    width: int = 600
    turned: bool = True
    radii: tuple[float, float] | None = None

    def radius_bounds(self) -> tuple[float, float]:
        longest = max(self.height, self.width)
        return self.radii or (longest / 2, 2**0.5 * longest / 2)


@dataclass(frozen=True)
class Settings:
    folders: Folders
    extensions: tuple[str, ...] = ("tiff", "tif")
    mask_extension: str = ".png"
    only: tuple[str, str] | None = None
    segmentation: Segmentation = field(default_factory=Segmentation)
    registration: Registration = field(default_factory=Registration)
    windows: Windows = field(default_factory=Windows)
