"""Settings: defaults, environment, command line."""

from __future__ import annotations

import argparse
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    start_url: str = "https://example.org/tags/"
    output: str = "data"
    user_agent: str = "Mozilla/5.0 (compatible; quellwerk/1.0)"
    timeout_ms: int = 30_000
    delay_ms: int = 1_000
    retries: int = 4
    retry_base_ms: int = 1_000
    concurrency: int = 4
    max_pages: int = 0  # of a tag; 0: no limit
    url_pattern: str = ""
    mode: str = "incremental"
    stop_after_known: int = 2
    min_width: int = 400
    min_height: int = 400
    min_bytes: int = 20 * 1024
    image_extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "gif")
    video_extensions: tuple[str, ...] = ("mp4", "webm", "m4v", "mov", "ogv")
    # Parts of urls that mark decoration, not content.
    blocked: tuple[str, ...] = ("thumb", "thumbnail", "avatar", "/icon", "icons/", "emoji", "logo", "sprite", "badge", "pixel", "spacer", "placeholder",
                                "/ad/", "/ads/", "banner", "tracking")
    tag_link: str = ".tags-cloud a"
    post: str = "div.topicbox"
    ad: str = ".ad, .ads, .sponsored, .promoted"
    post_text: str = "div.text"
    next_page: str = ".pageslist a"
    next_text: str = "след"
    post_content: str = "body"
    dry_run: bool = False
    stop_on_empty: bool = True
    min_length: int = 15


# Names of the environment variables.
ENVIRONMENT = {
    "START_URL": "start_url", "OUTPUT_DIR": "output", "USER_AGENT": "user_agent", "REQUEST_TIMEOUT_MS": "timeout_ms", "REQUEST_DELAY_MS": "delay_ms",
    "MAX_RETRIES": "retries", "RETRY_BASE_DELAY_MS": "retry_base_ms", "DOWNLOAD_CONCURRENCY": "concurrency", "MAX_PAGES": "max_pages",
    "PAGINATION_PATTERN": "url_pattern", "CRAWL_MODE": "mode", "STOP_AFTER_KNOWN_PAGES": "stop_after_known", "MIN_WIDTH": "min_width",
    "MIN_HEIGHT": "min_height", "MIN_BYTES": "min_bytes", "ALLOWED_EXTENSIONS": "image_extensions", "VIDEO_EXTENSIONS": "video_extensions",
    "EXCLUDE_URL_PATTERNS": "blocked", "SEL_TAG_LINK": "tag_link", "SEL_POST": "post", "SEL_AD": "ad", "SEL_ANECDOTE_TEXT": "post_text",
    "SEL_NEXT": "next_page", "SEL_NEXT_TEXT": "next_text", "SEL_POST_CONTENT": "post_content", "DRY_RUN": "dry_run",
    "STOP_ON_EMPTY_PAGE": "stop_on_empty", "ANECDOTE_MIN_LENGTH": "min_length",
}


def from_env(env: Mapping[str, str] = os.environ) -> Config:
    """Settings of `env` over the defaults; empty values count as unset, numbers are read as far as they go."""
    found = {}
    kinds = {f.name: type(getattr(Config, f.name)) for f in fields(Config)}
    for key, name in ENVIRONMENT.items():
        value = env.get(key, "")
        if value == "":
            continue
        if kinds[name] is bool:
            found[name] = value.strip().lower() in ("1", "true", "yes", "on")
        elif kinds[name] is int:
            if m := re.match(r"\s*[+-]?\d+", value):
                found[name] = int(m[0])
        elif kinds[name] is tuple:
            found[name] = tuple(p for x in value.split(",") if (p := x.strip()))
        else:
            found[name] = value
    return replace(Config(), **found)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quellwerk", description="Harvest text posts from listing pages.")
    for flag, name, help_ in (
        ("start-url", "start_url", "index page of the tags"), ("max-pages", "max_pages", "pages of a tag at most (0: no limit)"),
        ("concurrency", "concurrency", "parallel downloads"), ("delay", "delay_ms", "least ms between requests to a host"),
        ("timeout", "timeout_ms", "ms for a request"), ("retries", "retries", "further attempts after a failure"), ("min-width", "min_width", "least width kept"),
        ("min-height", "min_height", "least height kept"), ("min-bytes", "min_bytes", "least file size kept"), ("output", "output", "output folder"),
        ("user-agent", "user_agent", "user agent"), ("stop-after-known", "stop_after_known", "known pages in a row that end a tag")):
        p.add_argument(f"--{flag}", dest=name, help=help_, type=int if isinstance(getattr(Config, name), int) else str)
    p.add_argument("--full", dest="mode", action="store_const", const="full", help="walk every page")
    p.add_argument("--dry-run", dest="dry_run", action="store_const", const=True, help="write nothing")
    return p


def from_args(base: Config, argv: list[str]) -> Config:
    """`base` with the flags of `argv` over it; unknown flags and malformed numbers are errors."""
    return replace(base, **{k: v for k, v in vars(parser().parse_args(argv)).items() if v is not None and v != ""})
