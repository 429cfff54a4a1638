"""Language models, embedders and rerankers as injected interfaces, with stand-ins that need no service."""
