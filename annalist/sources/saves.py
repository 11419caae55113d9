"""Save archives: listing, bounded metadata, and the identity of the played character. One file a row; errors are a column."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import script
from annalist.sources.script_files import RANKS

MEMBER, PREFIX = "gamestate", 1 << 20
METADATA = "path string, error string, save_game_version int, game_version string, game_date string, player_name string, title_name string, player_tier int, player_character_id long, house_name string, government_id string, dlcs array<string>, can_get_achievements boolean, ironman boolean"
IDENTITY = "path string, error string, player_character_id long, primary_title_id string, realm_capital_title_id string, domain_title_ids array<string>, culture_id long, faith_id long, house_id long"
# Tiers as saves number them.
TIERS = {1: "barony", 2: "county", 3: "duchy", 4: "kingdom", 5: "empire"}


def candidates(files: DataFrame, limit: int = 50) -> DataFrame:
    """The newest saves; equal times by lower-cased name."""
    return files.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), F.lower(F.element_at(F.split("path", "/"), -1))).limit(limit)


def fields(block: str) -> dict[str, str]:
    """Assignments of a block's first level; the last of a key counts."""
    return {a.key: a.raw if a.kind == "block" else script.scalar(a.raw) for a in script.assignments(block[1:-1])}


def block_of(text: str, key: str) -> str:
    """The block that `key={` opens, found by counting braces outside quotes."""
    opened = re.search(rf"(?<![\w.-]){re.escape(key)}\s*=\s*(?=\{{)", text)
    if not opened:
        raise ValueError(f"no {key}")
    depth = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]', text[opened.end() :]):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[opened.end() : opened.end() + m.end()]
    raise ValueError(f"{key} isn't closed within its bound")


def records(lines: Iterable[bytes], openers: set[str]) -> Iterator[tuple[str, dict[str, str]]]:
    """Blocks whose opening line is one of those wanted, as fields. The stream is never held whole."""
    held: list[str] = []
    depth, name = 0, ""
    for raw in lines:
        text = raw.decode("utf-8", "replace")
        if not held:
            name = text.strip()
            if name not in openers:
                continue
        held.append(text)
        braces = re.sub(r'"(?:\\.|[^"\\])*"', "", text)
        depth += braces.count("{") - braces.count("}")
        if depth <= 0:
            whole = "".join(held)
            yield name, fields(whole[whole.index("{") :].strip())
            held, depth = [], 0


def _metadata(content: bytes) -> tuple:
    with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(MEMBER) as stream:
        f = fields(block_of(stream.read(PREFIX).decode("utf-8", "replace"), "meta_data"))
    flag = {"yes": True, "no": False}
    return (
        int(f["save_game_version"]), f["version"], f["meta_date"], f["meta_player_name"], f["meta_title_name"], int(f["meta_player_tier"]), int(fields(f["meta_main_portrait"])["id"]),
        f.get("meta_house_name"), f.get("meta_government"), re.findall(r'"([^"]*)"', f.get("dlcs", "")), flag[f["can_get_achievements"]], flag[f["ironman"]],
    )


def _identity(content: bytes) -> tuple:
    meta = _metadata(content)
    tier, player = meta[5], meta[6]
    person, played = None, None
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        with archive.open(MEMBER) as stream:
            for name, f in records(stream, {f"{player}={{", "played_character={"}):
                if name.startswith("played"):
                    played = int(f["character"])
                elif "first_name" in f and "landed_data" in f:
                    person = person or f
                if person and played is not None:
                    break
        if person is None or played != player:
            raise ValueError("the played character isn't that of the metadata")
        land = fields(person["landed_data"])
        domain = [int(x) for x in re.findall(r"-?\d+", land["domain"])]
        held: dict[int, dict[str, str]] = {}
        with archive.open(MEMBER) as stream:
            for name, f in records(stream, {f"{n}={{" for n in domain}):
                if "key" in f:
                    held[int(name[:-2])] = f
                if len(held) == len(set(domain)):
                    break
    rank = {n: RANKS[f["key"][0]] for n, f in held.items()}
    primary = [n for n in domain if rank[n] == TIERS[tier] and int(held[n].get("holder", -1)) == player]
    capital = int(land["realm_capital"])
    if not primary or rank.get(capital) != "barony":
        raise ValueError("no primary title or capital barony in the domain")
    return player, held[primary[0]]["key"], held[capital]["key"], [held[n]["key"] for n in domain], int(person["culture"]), int(person["faith"]), int(person["dynasty_house"])


def _each(files: DataFrame, read, schema: str) -> DataFrame:
    empty = [None] * (len(schema.split(", ")) - 2)

    def row(path: str, content: bytes) -> tuple:
        try:
            return path, None, *read(bytes(content))
        except (KeyError, ValueError, zipfile.BadZipFile) as error:
            return path, f"{type(error).__name__}: {error}", *empty

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from script.framed((row(path, content) for batch in batches for path, content in zip(batch["path"], batch["content"])), schema)

    return files.select("path", "content").mapInPandas(run, schema)


def metadata(files: DataFrame) -> DataFrame:
    """Metadata from at most the first MiB of each save."""
    return _each(files, _metadata, METADATA)


def identity(files: DataFrame) -> DataFrame:
    """Player, primary title, capital and domain of each save."""
    return _each(files, _identity, IDENTITY)
