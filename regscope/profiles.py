"""Per-registry differences in one place (lists, gates, widths, author key)."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import constants as C


@dataclass(frozen=True)
class RegistryProfile:
    name: str
    author_col: str
    internal_hosts: tuple
    short_hosts: tuple
    platform: str
    top_k_words: int
    own_features: tuple            # order of the package's own vector
    context_features: tuple        # order of the block the author context blends
    extra_features: tuple = field(default=())


IMAGE = RegistryProfile(
    name="image", author_col="namespace",
    internal_hosts=tuple(C.INTERNAL_HOSTS["image"]), short_hosts=tuple(C.SHORT_HOSTS["image"]),
    platform="docker", top_k_words=10,
    own_features=("code_md", "code_blocks", *[f"sem_{i}" for i in range(10)],
                  "url_external", "url_short", "url_domains", "url_rank", "url_dups"),
    context_features=("url_external", "url_short", "url_domains", "url_rank", "url_dups",
                      "code_md", "code_blocks", *[f"sem_{i}" for i in range(10)]),
    extra_features=("popularity",),
)

NPM = RegistryProfile(
    name="npm", author_col="user_name",
    internal_hosts=tuple(C.INTERNAL_HOSTS["npm"]), short_hosts=tuple(C.SHORT_HOSTS["npm"]),
    platform="npm", top_k_words=20,
    own_features=("code_blocks", *[f"sem_{i}" for i in range(10)],
                  "url_external", "url_short", "url_domains", "url_rank", "url_dups",
                  "has_repo", "homepage_rank", "email_rank", "readme_flag"),
    context_features=("code_blocks", *[f"sem_{i}" for i in range(10)],
                      "url_external", "url_short", "url_domains", "url_rank", "url_dups",
                      "has_repo", "homepage_rank", "email_rank", "readme_flag"),
)

NUGET = RegistryProfile(
    name="nuget", author_col="author",
    internal_hosts=tuple(C.INTERNAL_HOSTS["nuget"]), short_hosts=tuple(C.SHORT_HOSTS["nuget"]),
    platform="nuget", top_k_words=10,
    own_features=("readme_flag", *[f"sem_{i}" for i in range(10)],
                  "url_external", "url_short", "url_domains", "url_rank", "url_dups",
                  "license", "repo_score"),
    context_features=("url_external", "url_short", "url_domains", "url_rank", "url_dups",
                      "repo_score", "readme_flag", "license", *[f"sem_{i}" for i in range(10)]),
)

PROFILES = {p.name: p for p in (IMAGE, NPM, NUGET)}
