"""Field definitions, keywords and limits. Fixed values throughout: they decide results."""

# Fixed values, v2: field, keywords, whole-value pattern, search width and height, several words allowed
FLEXIBLE = [
    ("monto", ["Bs", "Monto", "Total", "Importe", "Valor", "Monto Total", "Bs.D", "bolivares"], r"^\d{1,3}(?:[.,]\d{3})*,\d{2}$|^\d+[,.]\d{2}$|^\d+(\.\d+)?$", 300, 100, False),
    ("fecha", ["Fecha:", "Fecha", "Dia", "Día", "Date", "Fechas"], r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$|^\d{4}[/-]\d{1,2}[/-]\d{1,2}$", 200, 50, False),
    ("operacion", ["Operación:", "Operacion", "Nro Operación", "Número Operación", "Ref", "Referencia"], r"^\d{8,20}$|^[A-Z0-9]{8,20}$", 350, 50, False),
    ("identificacion", ["Identificación:", "Identificacion", "C.I.", "CI", "Cédula", "Cedula", "V-", "E-", "J-"], r"^[VEJ]-?\d{7,9}$|^\d{7,9}$", 200, 50, False),
    ("origen_numero", ["Origen:", "Origen", "Telefono Origen", "Cta Origen", "Cuenta Origen"], r"^\d{10,}$|^[X*]{3,}\d{4}$", 250, 50, False),
    ("destino_numero", ["Destino:", "Destino", "Telefono Destino", "Cta Destino", "Cuenta Destino"], r"^\d{10,}$", 250, 50, False),
    ("banco_completo", ["Banco:", "Banco", "Bco", "Banco Origen", "Banco Destino"], r"^[A-Za-z\s\d\-]+$|^\d{4}\s*-\s*[A-Za-z\s]+$", 500, 50, True),
    ("concepto", ["Concepto:", "Concepto", "Desc", "Descripción", "Detalle"], r"^.+$", 400, 100, True),
]
GENERAL_SCAN = ("nombre_o_info_completa", r"^[A-Za-zÀ-ÿ\s]{5,}$", 60)

# v3 differs from v2 in these fields only
EXPANSION = [
    (f, ["Bs", "Monto", "Total", "Pago", "Importe", "Valor", "Monto Total", "Bs.D"] if f == "monto" else k, r"^[A-Za-z\s]+$|^\d{4}\s*-\s*[A-Za-z\s]+$" if f == "banco_completo" else p)
    for f, k, p, *_ in FLEXIBLE
]

# Fixed values, v1 zones: keywords; beside the keyword with this width, or below it
ZONES_V1 = [
    ("monto", ["monto", "bs", "total", "cantidad", "bolivares"], "beside", 150),
    ("referencia", ["referencia", "ref", "numero", "operacion"], "beside", 200),
    ("fecha", ["fecha", "hora", "timestamp"], "beside", 120),
    ("cedula_origen", ["cedula", "c.i", "ci", "origen"], "beside", 100),
    ("cedula_destino", ["destino", "beneficiario"], "beside", 100),
    ("banco_origen", ["banco", "origen", "emisor"], "below", 200),
    ("banco_destino", ["banco", "destino", "receptor"], "below", 200),
]

# Fixed values, "fixed" zones: keywords; fallback region as shares of the image
ZONES_FIXED = [
    ("monto", ["bs", "bolivares", "monto", "total"], (0.3, 0.25, 0.4, 0.1)),
    ("referencia", ["operacion", "operación", "ref", "referencia", "numero"], (0.4, 0.5, 0.5, 0.08)),
    ("fecha", ["fecha"], (0.5, 0.4, 0.4, 0.08)),
    ("cedula_origen", ["origen", "identificacion", "identificación"], (0.4, 0.65, 0.4, 0.08)),
    ("cedula_destino", ["destino"], (0.4, 0.75, 0.4, 0.08)),
    ("banco_origen", ["banco"], (0.2, 0.85, 0.6, 0.08)),
    ("banco_destino", ["banco"], (0.2, 0.85, 0.6, 0.08)),
]

# The template that ships.
TEMPLATE = "APPPAGO-V-0102-v1"
TEMPLATE_ANCHORS = ["Pago Móvil", "Transferencia", "Monto", "Referencia", "Bs", "C.I.", "Banco"]
TEMPLATE_REGIONS = [("header_region", 0.1, 0.05, 0.8, 0.15), ("amount_region", 0.1, 0.25, 0.8, 0.2), ("details_region", 0.1, 0.5, 0.8, 0.35)]

# Its fields, with left, top, width and height.
TEMPLATE_FIELDS = [
    ("monto", 150, 200, 200, 40), ("referencia", 150, 300, 250, 35), ("fecha", 150, 400, 180, 35), ("cedula_origen", 150, 500, 120, 30),
    ("cedula_destino", 150, 550, 120, 30), ("banco_origen", 50, 600, 200, 30), ("banco_destino", 300, 600, 200, 30),
]

# Confidence adjustments by cause.
ADJUSTMENTS = {
    "mala_segmentacion": -10.0, "caracter_mal_reconocido": -5.0, "campo_no_detectado": -15.0, "error_de_plantilla": -8.0, "formato_erroneo": -3.0,
    "info_faltante": -12.0, "ruido_imagen": -7.0, "distorsion_imagen": -6.0, "clasificacion_erronea_no_recibo": -20.0, "otro": -2.0,
}
# Reserved texts.
RESERVED_CORRECTIONS = ["total_correcciones", "last_updated", "confidence_adjustment"]
# Advice for a field.
FIELD_ADVICE = "Revisar configuración de ROI y patrones de validación"
# Advice for causes.
CAUSE_ADVICE = {
    "mala_segmentacion": "Considerar ajustar ROI base en plantillas o mejorar lógica de ZOI dinámicas",
    "caracter_mal_reconocido": "Evaluar mejoras en preprocesamiento de imagen o configuración de Tesseract",
    "campo_no_detectado": "Revisar palabras clave y heurísticas contextuales para detección de campos",
}
