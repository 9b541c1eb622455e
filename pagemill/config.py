"""Job options with the service's defaults and clamps."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# File extensions that are never crawled.
IGNORED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".js",
    ".pdf", ".zip", ".tar", ".gz", ".rar", ".mp4", ".mp3", ".wav",
)

# Main-content selectors, highest priority first.
MAIN_SELECTORS = (
    "main", "article", '[role="main"]', "#content", ".content", ".main",
    ".main-content", ".article", ".post", ".entry-content",
)


def _clamp(value, lo: int, hi: int, default: int) -> int:
    try:
        return max(lo, min(int(value), hi))
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class Config:
    """Options of one crawl / export job. The values given hold; ``None`` means no limit.

    ``service_limits()`` applies the request limits of the web service, for jobs that must agree with it."""

    max_pages: int | None = None
    max_depth: int | None = None
    min_text_chars: int = 600
    include_subdomains: bool = False
    allowed_hosts: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = ()
    respect_robots: bool = True
    strip_links: bool = True
    strip_images: bool = True
    readability_fallback: bool = True
    render_mode: str = "http"
    main_selectors: tuple[str, ...] = field(default=MAIN_SELECTORS)
    # options that switch off faithful-but-odd behaviour (off = faithful)
    empty_disallow: str = "block"  # "block" (faithful) or "allow" (the robots standard)

    def __post_init__(self) -> None:
        if self.render_mode not in ("http", "auto", "browser"):
            raise ValueError(f"unknown render_mode {self.render_mode!r}")

    def service_limits(self) -> "Config":
        """Pages 1..500, depth 1..6, min_text_chars 200..5000; hosts and prefixes stripped."""
        return replace(
            self,
            max_pages=_clamp(self.max_pages, 1, 500, 10),
            max_depth=_clamp(self.max_depth, 1, 6, 3),
            min_text_chars=_clamp(self.min_text_chars, 200, 5000, 600),
            allowed_hosts=tuple(h.strip().lower() for h in self.allowed_hosts if h and h.strip()),
            path_prefixes=tuple(p.strip() for p in self.path_prefixes if p and p.strip()),
        )
