from lodestone.sources.tables import Tables

__all__ = ["Tables"]
