"""Every query of the library by name, with its SQL."""

from . import codec, frames, ingestion, latent

QUERIES = ingestion.QUERIES | frames.QUERIES | latent.QUERIES | codec.QUERIES
ORACLES = ingestion.ORACLES | frames.ORACLES | latent.ORACLES | codec.ORACLES
