"""The decoders in the order they are tried, and what is known of a file from its bytes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..image import Raster
from ..operators.raster import DISPLAY_GAMMA
from . import coded, headers, simple
from .headers import About, Head
from .stream import Broken, Cursor, NotMine, trailing_options, unwrapped

Decoder = Callable[[Cursor, "Context"], Raster]
UNKNOWN = "no format accepts this file"


@dataclass(frozen=True)
class Context:
    """What decoders may need to know of the target and the job."""

    width: int = 0
    height: int = 0
    background: tuple[int, int, int] | None = None
    xpm: str = "c"
    iscale: int = 0
    gamma: float = DISPLAY_GAMMA


@dataclass
class Decoded:
    status: str  # ok, partial, error, unknown
    format: str | None = None
    raster: Raster | None = None
    error: str | None = None
    options: str | None = None
    zoom: tuple[int, int] = field(default=(100, 100))


@dataclass(frozen=True)
class Format:
    """decode: the image, or NotMine for data of other formats. header: what it is without its pixels; where there is none, files are decoded for that."""

    name: str
    decode: Decoder
    description: str
    trailing: bool = True
    header: Callable[[Head, Context], About] | None = None


@dataclass(frozen=True)
class Registry:
    """The formats in the order in which they are tried: a value, so that tasks take it with them to their workers."""

    formats: tuple[Format, ...]

    def __iter__(self) -> Iterator[Format]:
        return iter(self.formats)

    def __len__(self) -> int:
        return len(self.formats)

    def with_format(self, new: Format, priority: int) -> Registry:
        return Registry((*self.formats[:priority], new, *self.formats[priority:]))

    def without(self, name: str) -> Registry:
        return Registry(tuple(f for f in self.formats if f.name != name))


def plain(decode: Callable[[Cursor], Raster]) -> Decoder:
    return lambda c, context: decode(c)


def alone(header: Callable[[Head], About]) -> Callable[[Head, Context], About]:
    return lambda head, context: header(head)


BUILT_IN = Registry(
    (
        Format("fbm", plain(simple.fbm), "FBM image", header=alone(headers.fbm)),
        Format("sun", plain(simple.sun), "Sun raster", header=alone(headers.sun)),
        Format("cmu", plain(simple.cmu), "CMU window manager raster", header=alone(headers.cmu)),
        Format("pnm", plain(simple.pnm), "portable bitmap, graymap or pixmap", header=alone(headers.pnm)),
        Format("faces", plain(simple.faces), "Faces project image", header=alone(headers.faces)),
        Format("png", lambda c, x: coded.png(c, x.background), "PNG", trailing=False, header=alone(headers.png)),
        Format("gif", plain(coded.gif), "GIF", header=alone(headers.gif)),
        Format("jpeg", lambda c, x: coded.jpeg(c, x.iscale), "JPEG", header=lambda h, x: headers.jpeg(h, x.iscale)),
        Format("rle", plain(coded.utah), "Utah run length", header=alone(headers.utah)),
        Format("bmp", plain(simple.bmp), "BMP", trailing=False, header=alone(headers.bmp)),
        Format("pcd", lambda c, x: coded.photo_cd(c, x.width, x.height), "Photo CD", trailing=False, header=lambda h, x: headers.photo_cd(h, x.width, x.height)),
        Format("xwd", plain(simple.xwd), "X window dump", header=alone(headers.xwd)),
        Format("tga", plain(simple.tga), "Targa", trailing=False, header=alone(headers.tga)),
        Format("mcidas", plain(simple.mcidas), "McIDAS area", header=alone(headers.mcidas)),
        Format("g3", plain(coded.fax), "G3 fax", header=alone(headers.fax)),
        Format("pcx", plain(simple.pcx), "PC Paintbrush", header=alone(headers.pcx)),
        Format("img", plain(simple.gem), "GEM image", header=alone(headers.gem)),
        Format("mac", plain(simple.mac), "MacPaint", header=alone(headers.mac)),
        Format("xpm", lambda c, x: simple.xpm(c, x.xpm, x.background or (0, 0, 0)), "X pixmap", header=alone(headers.xpm)),
        Format("xbm", plain(simple.xbm), "X bitmap", header=alone(headers.xbm)),
    )
)
_current = BUILT_IN


def registry() -> Registry:
    """The formats known now, on the driver. Whoever sends work to Spark takes them along."""
    return _current


def use(formats: Registry) -> None:
    global _current
    _current = formats


def register_decoder(name: str, priority: int, decode: Decoder, description: str = "", trailing: bool = True, header: Callable[[Head, Context], About] | None = None) -> None:
    """Add a format: ``decode`` raises NotMine for data of other formats. priority: its place in the order."""
    use(_current.with_format(Format(name, decode, description or name, trailing, header), priority))


def decoded(name: str, content: bytes, context: Context = Context(), formats: Registry | None = None) -> Decoded:
    """Decode a file by the first format that accepts it. Never raises: what went wrong is in the result."""
    try:
        data = unwrapped(name, content)
    except Exception as e:  # a damaged wrapper
        return Decoded("error", error=f"{type(e).__name__}: {e}")
    for f in formats or _current:
        c = Cursor(data)
        try:
            raster = f.decode(c, context)
        except NotMine:
            continue
        except Broken as e:
            return Decoded("error", f.name, error=str(e))
        except (ValueError, IndexError, KeyError, OverflowError, MemoryError) as e:
            return Decoded("error", f.name, error=f"{type(e).__name__}: {e}")
        if not raster.title:
            raster = _titled(raster, name)
        aspect = getattr(raster, "aspect", 1.0)
        zoom = (100, 100) if aspect == 1 else (int(aspect * 100 + 0.5), 100) if aspect > 1 else (100, int(100 / aspect + 0.5))
        options = trailing_options(data[c.at :]) if f.trailing else None
        return Decoded("partial" if c.short else "ok", f.name, raster, "data ended early" if c.short else None, options, zoom)
    return Decoded("unknown", error=UNKNOWN)


def told_of(head: Head, context: Context = Context(), formats: Registry | None = None) -> tuple[str, Format | None, About | None, str | None]:
    """status, format, what the header says, error: by the first format that accepts a file. Never raises."""
    for f in formats or _current:
        try:
            about = f.header(head, context) if f.header else headers.whole(lambda c, f=f: f.decode(c, context), head)
            return "ok", f, about, None
        except NotMine:
            continue
        except Broken as e:
            return "error", f, None, str(e)
        except (ValueError, IndexError, KeyError, OverflowError, MemoryError, struct.error) as e:
            return "error", f, None, f"{type(e).__name__}: {e}"
    return "unknown", None, None, UNKNOWN


def _titled(raster: Raster, name: str) -> Raster:
    aspect = getattr(raster, "aspect", None)
    raster = raster.but(title=name.rsplit("/", 1)[-1])
    if aspect is not None:
        raster.aspect = aspect
    return raster
