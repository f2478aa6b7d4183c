"""Fixed values of the domain: word lists, patterns and labels that results depend on.

They are the defaults of parameters; every operator takes others.
"""

from __future__ import annotations

# Content types, in order of priority, with strong (2 points) and weak (1 point) words.
CONTENT_TYPES: dict[str, tuple[list[str], list[str]]] = {
    "kriteria_penerima": (
        ["syarat penerima", "kriteria penerima", "sasaran penerima", "persyaratan penerima", "calon penerima", "berhak menerima", "tidak berhak menerima", "tidak eligible", "eligible", "desil 1", "desil 2", "dtks", "dtsen", "terdata dalam", "terdaftar dalam", "disabilitas berat", "lanjut usia 70", "lansia 70", "keluarga penerima manfaat kpm", "perempuan kepala keluarga", "miskin ekstrem"],
        ["syarat", "kriteria", "sasaran", "penerima manfaat", "berhak", "layak", "memenuhi", "ketentuan", "disabilitas", "lansia", "miskin", "tidak mampu", "kpm", "pkh", "dtks"],
    ),
    "nominal_bantuan": (
        ["nominal bantuan", "besaran bantuan", "jumlah bantuan", "senilai rp", "sebesar rp", "rp.", "per tahap", "per triwulan", "per bulan", "per tahun", "nilai bantuan", "dana bantuan sebesar", "paket bantuan", "bantuan tunai"],
        ["rp", "rupiah", "nominal", "besaran", "jumlah", "dana", "anggaran", "biaya", "tahap", "triwulan"],
    ),
    "mekanisme_penyaluran": (
        ["penyaluran dana", "pencairan dana", "rekening penerima", "bank penyalur", "pemindahbukuan", "sp2d", "spm", "standing instruction", "transfer dana", "buku tabungan", "pembukaan rekening", "rekening kolektif", "penyaluran bantuan"],
        ["penyaluran", "pencairan", "rekening", "bank", "transfer", "tabungan", "cair", "salur", "bank jatim", "bpkad", "bendahara"],
    ),
    "prosedur_verifikasi": (
        ["verifikasi dan validasi", "assessment lapangan", "kunjungan lapangan", "verifikasi administrasi", "penetapan penerima", "seleksi penerima", "pemutakhiran data", "musyawarah desa", "musdes", "muskel", "sk gubernur", "sk bupati", "keputusan gubernur", "keputusan bupati"],
        ["verifikasi", "validasi", "assessment", "seleksi", "penetapan", "pemutakhiran", "musyawarah", "lapangan", "kunjungan", "pendataan", "sk"],
    ),
    "lampiran_formulir": (
        ["lampiran", "formulir", "rab", "rencana anggaran belanja", "surat pernyataan", "pakta integritas", "surat kuasa", "proposal permohonan", "berita acara", "kartu keluarga", "ktp", "surat keterangan", "dokumen persyaratan"],
        ["lampiran", "formulir", "surat", "dokumen", "berkas", "proposal", "rab", "kk", "ktp", "identitas", "administrasi"],
    ),
    "pendahuluan_umum": (
        ["latar belakang", "kata pengantar", "dasar hukum", "landasan hukum", "undang-undang nomor", "peraturan menteri", "peraturan gubernur", "tujuan program", "maksud dan tujuan", "ruang lingkup", "pengertian"],
        ["pendahuluan", "latar belakang", "tujuan", "dasar", "hukum", "peraturan", "kebijakan", "definisi", "istilah", "umum"],
    ),
}
NO_TYPE = "lainnya"
# Short words that count only as whole words.
WHOLE_WORDS = ["rp", "rab", "kk", "ktp", "sk", "spm", "sp2d"]
# Hints of a preface, and what still makes it concrete.
INTRO_HINTS = ["kata pengantar", "puji syukur", "ucapan terima kasih", "apresiasi", "surabaya,", "kepala dinas"]
CONCRETE_HINTS = ["syarat", "kriteria", "sasaran", "desil", "dtks", "dtsen"]
# Patterns that an amount label needs, and those of a policy signal.
MONEY_PATTERNS = [r"\brp\.?\s*\d", r"\brupiah\b", r"\brab\b", "rencana anggaran", "harga satuan", "jumlah biaya", "besaran bantuan", "nominal bantuan", "nilai bantuan"]
POLICY_PATTERNS = [
    r"\brp\.?\s*\d", r"\bdesil\b", r"\bdtks\b", r"\bdtsen\b", r"\bsyarat\b", r"\bkriteria\b", r"\bsasaran\b", r"\bverifikasi\b", r"\bvalidasi\b",
    r"\bpencairan\b", r"\bpenyaluran\b", r"\brekening\b", r"\bsp2d\b", r"\bspm\b", r"\brab\b", r"\bktp\b", r"\bkk\b",
]

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "PKH": "Program Keluarga Harapan", "BPNT": "Bantuan Pangan Non Tunai", "KPM": "Keluarga Penerima Manfaat", "BLT": "Bantuan Langsung Tunai",
    "KKS": "Kartu Keluarga Sejahtera", "KPA": "Kuasa Pengguna Anggaran", "PPKE": "Percepatan Penghapusan Kemiskinan Ekstrem", "BBM": "Bahan Bakar Minyak",
    "APBN": "Anggaran Pendapatan dan Belanja Negara", "APBD": "Anggaran Pendapatan dan Belanja Daerah", "DTKS": "Data Terpadu Kesejahteraan Sosial",
    "SPM": "Surat Perintah Membayar", "PAUD": "Pendidikan Anak Usia Dini", "TKPK": "Tim Koordinasi Penanggulangan Kemiskinan",
    "KPPN": "Kantor Pelayanan Perbendaharaan Negara", "KUR": "Kredit Usaha Rakyat", "BUMN": "Badan Usaha Milik Negara", "RPL": "Rekening Pemerintah Lainnya",
    "TNI": "Tentara Nasional Indonesia", "APIP": "Aparat Pengawasan Intern Pemerintah", "JKN": "Jaminan Kesehatan Nasional",
    "PUPR": "Pekerjaan Umum dan Perumahan Rakyat", "PIP": "Program Indonesia Pintar", "KIP": "Kartu Indonesia Pintar", "ASN": "Aparatur Sipil Negara",
    "SIKS-NG": "Sistem Informasi Kesejahteraan Sosial Next-Generation", "OM-SPAN": "Online Monitoring Sistem Perbendaharaan dan Anggaran Negara",
}
# Patterns (case ignored) and the tags that a text gets for the embedding.
AUGMENT_RULES = [
    (r"Rp\.?\s*[\d.,]+", "[nominal bantuan sosial besaran dana]"),
    ("(usia produktif|keluarga rentan|miskin|tidak mampu|rentan)", "[kriteria sasaran penerima]"),
    ("(KTP|KK|kartu keluarga|NIK|surat domisili)", "[syarat dokumen persyaratan]"),
    ("(rekening|transfer|bank|pencairan|penyaluran)", "[mekanisme pencairan penyaluran]"),
    ("(DTSEN|DTKS|data terpadu|desil)", "[data kemiskinan desil eligibilitas]"),
]
PROGRAM_TAGS = {
    "ASPD": "[asistensi sosial penyandang disabilitas ASPD]",
    "Kemiskinan Ekstrem": "[penanganan kemiskinan ekstrem miskin ekstrem desil 1]",
    "PKH Plus": "[PKH Plus lanjut usia lansia 70 tahun]",
    "KIP KPM Jawara": "[KIP KPM JAWARA kewirausahaan keluarga penerima manfaat]",
    "KIP PPKS Jawara": "[KIP PPKS JAWARA pemerlu pelayanan kesejahteraan sosial]",
    "KIP Putri Jawara": "[KIP Putri JAWARA perempuan tangguh wirausaha]",
}
# Titles that say nothing; the text and title of a page that could not be read.
EMPTY_TITLES = ["tabel/diagram", "ekstraksi gagal", "i", "ii", "iii", "iv", "v"]
UNPREFIXED_TITLES = ["Tabel/Diagram", "Ekstraksi Gagal", "**", ""]
FAILED_TEXT, FAILED_TITLE = "Gagal memuat menggunakan Vision LLM", "Ekstraksi Gagal"

# Terms of severe disability and terms that deny it.
DISABILITY_TERMS = ["banyak kesulitan", "tidak bisa", "sama sekali tidak bisa", "tidak mampu", "membutuhkan bantuan", "disabilitas", "bedridden", "bed ridden"]
NO_DISABILITY_TERMS = ["tidak mengalami kesulitan", "sedikit kesulitan, tapi tidak membutuhkan bantuan", "tidak membutuhkan bantuan", "tidak ada disabilitas", "bukan penyandang disabilitas"]

# Amounts, the words that make them aid, and the stamp duty that is not.
AMOUNT = r"(?i)\bRp\.?\s*([0-9][0-9.,\s]*)(?:,-|,00)?"
AID_CONTEXT = r"(?i)\b(bantuan|bansos|besaran|nominal|sebesar|senilai|per orang|per tahap|tahap|disalurkan|diterima|penerima manfaat)\b"
STAMP_DUTY = r"(?i)\b(materai|bea\s+materai)\b.{0,50}\brp\b|\brp\b.{0,50}\b(materai|bea\s+materai)\b"

# Ordinals of decree clauses, in order.
ORDINALS = ["KESATU", "KEDUA", "KETIGA", "KEEMPAT", "KELIMA", "KEENAM", "KETUJUH", "KEDELAPAN", "KESEMBILAN", "KESEPULUH", "KESEBELAS", "KEDUA BELAS", "KETIGA BELAS", "KEEMPAT BELAS", "KELIMA BELAS", "KEENAM BELAS", "KETUJUH BELAS", "KEDELAPAN BELAS", "KESEMBILAN BELAS", "KEDUA PULUH"]
# Lines that are noise, end the document, are cut at a page break, or open a preamble.
NOISE_LINES = [r"^-\s*[\dt]+\s*-$", r"^(PRES[IT]DEN|REPU[BLEUK]+[A-Z]?\s+[IT]NDONESIA)$", r"^SK\s+No\s+\d+.*$", r"^BAB\s*[IVXLCDM]+\s*\.\.\.$", r"^Agar\s*\.\s*\.\s*\.?", r"jdih\.\w+\.go\.id", r"^Salinan sesuai dengan aslinya", r"^(ttd|Plt\.|NIP)"]
STOP_LINE = r"(?i)^(Disahkan di\s|Ditetapkan di\s|Diundangkan di\s|PENJELASAN\s+A\s*T\s*A\s*S|Agar setiap orang mengetahuinya|Salinan sesuai dengan aslinya)"
PAGE_BREAK = r"\.\s*\.\s*\.\s*$"
INTRO_LINE = r"(?i)^(Dalam\s+Undang|Dengan\s+persetujuan\s+bersama)"
PREAMBLE_LINE = r"(?i)^(Menimbang|Mengingat|MEMUTUSKAN|Menetapkan)\s*:"
CONNECTORS = ["diktum", "pasal", "dalam", "yaitu", "meliputi", "dan", "sebagaimana", "pada", "tentang", "bahwa", "keputusan", "ayat"]
CLOSING = r"(?i)(?:Agar setiap orang mengetahuinya|Disahkan di [A-Z][a-z]+|Ditetapkan di [A-Z][a-z]+|Diundangkan di [A-Z][a-z]+|memerintahkan pengundangan|Salinan sesuai dengan aslinya)"
SMALL_WORDS = ["dan", "atau", "di", "ke", "dari", "yang", "dalam", "untuk", "dengan", "pada", "serta", "atas"]
# Categories by the first group of words that a title holds.
CATEGORIES = [
    (["juknis", "petunjuk teknis", "sop", "prosedur"], "Juknis (Petunjuk Teknis & SOP)"),
    (["pedoman", "rencana", "aksi", "panduan"], "Pedoman Program (Rencana Kerja & Aksi)"),
    (["data", "laporan", "statistik", "analisis", "survei"], "Data dan Laporan Analisis"),
]
DEFAULT_CATEGORY = "Regulasi (Aturan Hukum & Payung Kebijakan)"

# Programs and their other names; statuses of an answer, worst first.
PROGRAM_ALIASES = {
    "ASPD": ["aspd", "asistensi sosial penyandang disabilitas"],
    "Kemiskinan Ekstrem": ["kemiskinan ekstrem", "penanganan kemiskinan ekstrem"],
    "PKH Plus": ["pkh plus"],
    "KIP KPM Jawara": ["kip kpm jawara", "kip kpm", "kpm jawara"],
    "KIP PPKS Jawara": ["kip ppks jawara", "kip ppks", "ppks jawara"],
    "KIP Putri Jawara": ["kip putri jawara", "kip putri", "putri jawara"],
}
STATUS_LABELS = {"eligible": "eligible", "mungkin eligible": "mungkin_eligible", "tidak eligible": "tidak_eligible", "non eligible": "tidak_eligible", "non-eligible": "tidak_eligible"}
FORBIDDEN_SECTIONS = ["rekomendasi bantuan tambahan", "rekomendasi tambahan", "bantuan lain", "rekomendasi tindak lanjut", "catatan untuk petugas"]
# Display names of the two programs in service and the titles of their sources.
ELDERLY_PROGRAM, ELDERLY_SOURCE = "PKH Plus (Lanjut Usia 70+)", "JUKNIS PKH PLUS 2026.pdf"
DISABILITY_PROGRAM, DISABILITY_SOURCE = "Asistensi Sosial Penyandang Disabilitas (ASPD)", "Juklak ASPD Tahun 202620260225_12303533_01.pdf"
PROGRAM_NAMES = [ELDERLY_PROGRAM, DISABILITY_PROGRAM]

# What opens a line of a regulation; {names} stands for the ordinals of a decree.
CHAPTER_LINE = r"(?i)^BAB\s+([IVXLCDM]+)(?:(?:\s*[–\-—]\s*|\s+)(.+))?$"
PART_LINE = r"(?i)^Bagian\s+(\w+)"
ARTICLE_LINE = r"(?i)^Pasal\s+(\d+)\.?\s*$"
DECREE_LINE = r"(?i)^(?:DIKTUM|Pasal)?\s*({names})\s*:?\s*(.*)$"
CLAUSE_LINE = r"^(?:\((\d+)\)|(\d+)\.)\s*(.*)"
LETTER_LINE = r"(?i)^([a-z])\.\s*(.*)"

# What stands between the ends of a range of deciles.
DECILE_TO = r"(?:-|s/d|sd|sampai(?:\s+dengan)?)"

# A heading with a status, a plain heading, and a decision in the text below one.
STATUS_HEADING = r"(?im)^#{2,4}\s*(.+?)\s*(?:â€”|—|–|-|:)\s*STATUS\s*:\s*(TIDAK\s+ELIGIBLE|NON[-\s]+ELIGIBLE|MUNGKIN\s+ELIGIBLE|ELIGIBLE)\b.*$"
PLAIN_HEADING = r"(?im)^##(?!#)\s*(.+?)\s*$"
DECISION = r"\b(?:status|keputusan)\s*:?\s*\**\s*(tidak\s+eligible|non[-\s]+eligible|mungkin\s+eligible|eligible)\b"

#: Where a text's lines end.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: Metadata that every chunk must have, that chunks of main sources must have, those sources, and the priorities.
CORE_FIELDS = ("sumber", "page_number")
CLEAN_FIELDS = ("nama_bansos", "tipe_konten", "tipe_konten_primer", "retrieval_priority")
MAIN_SOURCES = (
    "Juklak ASPD Tahun 202620260225_12303533_01.pdf",
    "JUKNIS KEMISKINAN EKSTREM (13-1-2025)-1 (1) (2).pdf",
    "JUKNIS PKH PLUS 2026.pdf",
    "PETUNJUK TEKNIS KIP KPM JAWARA.pdf",
    "Petunjuk Teknis KIP PPKS Jawara 2026.pdf",
    "PETUNJUK TEKNIS KIP PUTRI JAWARA.pdf",
)
PRIORITIES = ("normal", "low")

#: Titles of pages without one, read in two halves, and read natively after all.
UNTITLED, SPLIT_TITLE, NATIVE_TITLE = "Tabel/Diagram", "Halaman Split", "Fallback Digital"

#: Sentences of an answer that is made without a model, with {age} and {decile} to be filled in.
ELDERLY_FITS = (
    "Warga berusia {age} tahun memenuhi syarat minimum lansia 70 tahun ke atas sesuai Juknis PKH Plus 2026 Pasal Sasaran Penerima. "
    "Desil nasional {decile} masuk klaster prioritas 1–4 dan status DTSEN tercatat aktif."
)
ELDERLY_FAILS = {
    "lead": "Tidak memenuhi kriteria PKH Plus: ",
    "young": "usia warga {age} tahun belum memenuhi syarat minimum 70 tahun yang ditetapkan Juknis PKH Plus 2026",
    "no_age": "data usia warga tidak terdeteksi dari profil",
    "decile": "desil nasional {decile} berada di luar klaster prioritas 1–4 PKH Plus",
    "status": "status DTSEN tidak aktif atau tidak terdeteksi",
    "none": "Profil warga tidak memenuhi kriteria sasaran PKH Plus (Lanjut Usia 70+).",
}
DISABILITY_FITS = (
    "Warga memiliki indikasi hambatan fungsi/disabilitas yang tercatat pada profil, usia {age} tahun masuk rentang sasaran ASPD (hingga 60 tahun), "
    "dan desil nasional {decile} masuk klaster prioritas sesuai Juklak ASPD 2026."
)
DISABILITY_FAILS = {
    "lead": "Tidak memenuhi kriteria ASPD: ",
    "able": "tidak ditemukan indikasi hambatan fungsi/disabilitas pada profil warga (semua dimensi fungsional: 'Tidak mengalami kesulitan')",
    "old": "usia warga {age} tahun melebihi batas atas sasaran ASPD",
    "decile": "desil nasional {decile} berada di luar klaster prioritas ASPD",
    "none": "Profil warga tidak memenuhi kriteria sasaran ASPD berdasarkan data yang tersedia.",
}
FIELD_PLAN = (
    "Rencana aksi operasional dan pendampingan di lapangan untuk program {programs}. Penyaluran bantuan akan dikoordinasikan oleh Dinas Sosial Provinsi Jawa Timur "
    "bersama pihak kelurahan/kecamatan setempat, serta dilakukan monitoring dan evaluasi berkala untuk memastikan bantuan tepat sasaran."
)
