from .prep import prepare_stream, start_prepared_stream

__all__ = ["prepare_stream", "start_prepared_stream"]
