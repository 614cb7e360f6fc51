"""Loading: parsed papers, manifests, path metadata, bindings of given tables to the canonical ones."""
