"""What a request or a write may be refused for."""


class SearchError(ValueError):
    """A request that can't be served."""


class UnsupportedQuery(SearchError):
    pass


class UnsupportedAggregation(SearchError):
    pass


class NoSuchMapping(SearchError):
    pass


class InvalidFieldType(SearchError):
    pass


class DocumentExists(SearchError):
    """A create of an id that is there already."""


class UpdateNotAllowed(SearchError):
    """An update in an index whose documents have no lasting id."""
