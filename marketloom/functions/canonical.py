"""Primary chain and category, and canonical spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.scale import clean_number

# Chains tried first, by exact name.
PRIORITY_CHAINS = ["ethereum", "binance-smart-chain", "solana", "polygon-pos", "avalanche"]

# Chain names and their aliases, in order of precedence.
CHAIN_ALIASES = {
    "ethereum": ["eth", "erc20", "erc-20", "erc721", "erc-721"],
    "binance-smart-chain": ["bnb", "bsc", "bep20", "bep-20"],
    "solana": ["sol"],
    "polygon-pos": ["polygon", "matic"],
    "avalanche": ["avax"],
    "tron": ["trx"],
    "fantom": ["ftm"],
    "arbitrum": ["arb", "arbitrum-one"],
    "optimism": ["op"],
    "cosmos": ["atom", "cosmos-hub"],
    "polkadot": ["dot"],
    "cardano": ["ada"],
}

# Categories tried first, by exact name.
PRIORITY_CATEGORIES = [
    "layer-1", "defi", "nft", "gaming", "stablecoin", "meme", "dao", "exchange", "privacy", "real-world-assets",
]

# Category names and the fragments that select them, in order of precedence.
CATEGORY_ALIASES = {
    "defi": ["defi", "decentralized-finance", "decentralized-finance-defi", "yield-farming", "lending", "dex"],
    "nft": ["nft", "non-fungible-tokens", "non-fungible-tokens-nft", "collectibles"],
    "layer-1": ["layer-1", "layer1", "l1", "blockchain-service", "smart-contract-platform"],
    "layer-2": ["layer-2", "layer2", "l2", "scaling"],
    "gaming": ["gaming", "play-to-earn", "p2e", "game", "metaverse", "gaming-guild"],
    "privacy": ["privacy", "anonymity", "zero-knowledge"],
    "stablecoin": ["stablecoin", "stablecoin-algorithmically-stabilized", "stablecoin-asset-backed"],
    "meme": ["meme", "meme-token", "dog", "inu", "cat", "food"],
    "dao": ["dao", "governance"],
    "exchange": ["exchange", "exchange-token", "exchange-based", "centralized-exchange"],
    "infrastructure": ["infrastructure", "oracle", "bridge", "interoperability"],
    "real-world-assets": ["real-world-assets", "rwa", "tokenized-asset", "tokenization"],
}

# Spellings replaced when item records are verified.
CHAIN_SPELLINGS = {
    "bsc": "binance-smart-chain", "bnb chain": "binance-smart-chain", "binance": "binance-smart-chain",
    "eth": "ethereum", "matic": "polygon-pos", "polygon": "polygon-pos", "sol": "solana",
}
CATEGORY_SPELLINGS = {
    "defi": "defi", "decentralized-finance": "defi", "decentralized-finance-defi": "defi",
    "nft": "nft", "non-fungible-tokens": "nft", "non-fungible-tokens-nft": "nft",
    "layer1": "layer-1", "layer 1": "layer-1", "l1": "layer-1",
    "layer2": "layer-2", "layer 2": "layer-2", "l2": "layer-2",
    "gaming": "gaming", "play-to-earn": "gaming", "p2e": "gaming", "metaverse": "metaverse",
    "meme": "meme", "meme-token": "meme", "exchange": "exchange", "exchange-token": "exchange",
}


def primary_chain(platforms: Column) -> Column:
    """Exact priority names, then names and aliases ignoring case, then the first key, else ``unknown``."""
    keys = F.map_keys(platforms)
    lower = F.transform(keys, F.lower)
    exact = [F.when(F.array_contains(keys, c), c) for c in PRIORITY_CHAINS]
    alias = [
        F.when(F.arrays_overlap(lower, F.array(*[F.lit(a) for a in [name, *aliases]])), name)
        for name, aliases in CHAIN_ALIASES.items()
    ]
    return F.coalesce(*exact, *alias, F.try_element_at(keys, F.lit(1)), F.lit("unknown"))


def primary_category(categories: Column) -> Column:
    """Exact priority names, then a fragment match in table order, then the first category, else ``unknown``."""
    lower = F.transform(F.filter(categories, lambda c: c.isNotNull() & (c != "")), F.lower)
    exact = [F.when(F.array_contains(lower, c), c) for c in PRIORITY_CATEGORIES]

    def any_fragment(fragments: list[str]) -> Column:
        return F.exists(lower, lambda c: reduce(lambda a, b: a | b, [c.contains(f) for f in fragments]))

    alias = [F.when(any_fragment(fragments), name) for name, fragments in CATEGORY_ALIASES.items()]
    first = F.lower(F.try_element_at(categories, F.lit(1)))
    return F.coalesce(*exact, *alias, F.when(first != "", first), F.lit("unknown"))


def _respell(value: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    low = F.lower(value)
    return F.coalesce(F.try_element_at(pairs, low), low)


def verify_items(items: DataFrame, numeric: list[str]) -> DataFrame:
    """Missing columns get defaults, non-finite numbers become 0, nested nulls become empty, names are respelled."""
    out = items
    for c in numeric:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0.0))
    for c in ("chain", "primary_category"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit("unknown"))
    for c, t, empty in (
        ("categories", "array<string>", F.array()), ("platforms", "map<string,string>", F.create_map())
    ):
        value = F.col(c) if c in out.columns else F.lit(None).cast(t)
        out = out.withColumn(c, F.coalesce(value, empty.cast(t)))
    return out.withColumns(
        {
            **{c: F.coalesce(clean_number(F.col(c)), F.lit(0.0)) for c in numeric},
            "chain": _respell(F.col("chain"), CHAIN_SPELLINGS),
            "primary_category": _respell(F.col("primary_category"), CATEGORY_SPELLINGS),
        }
    )
