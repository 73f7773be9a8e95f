"""All registered queries; importing this package registers them."""

from loomlake.queries import aggregates, chain, digests, files, jobs, logs, more, reads, runs, search, speech, streams, surface, texts, vectors  # noqa: F401
