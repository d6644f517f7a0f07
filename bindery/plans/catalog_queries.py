"""Named catalog queries and the SQL each must agree with."""

from bindery.plans import audit, browse, cards, curation, guards, ingest, provenance, streams

QUERIES: dict = browse.QUERIES | ingest.QUERIES | audit.QUERIES | curation.QUERIES | guards.QUERIES | cards.QUERIES | streams.QUERIES | provenance.QUERIES
ORACLE: dict = browse.ORACLE | ingest.ORACLE | audit.ORACLE | curation.ORACLE | guards.ORACLE | cards.ORACLE | streams.ORACLE | provenance.ORACLE
