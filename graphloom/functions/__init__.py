"""Scalar functions on JSON texts, IRIs, paths, references and addresses."""
